"""Parts of the queries' SQL."""

from __future__ import annotations

LEV_SIM = "(1.0::DOUBLE - levenshtein(fraudulent_name, real_name)::DOUBLE / greatest(length(fraudulent_name), length(real_name)))"
CELLS = (
    "count_if(label = 1 AND p = 1)::BIGINT AS tp, count_if(label = 0 AND p = 1)::BIGINT AS fp, "
    "count_if(label = 0 AND p = 0)::BIGINT AS tn, count_if(label = 1 AND p = 0)::BIGINT AS fn"
)


# Threshold evaluation over scored(model, score, label)

POINTS = """hist AS (SELECT model, score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg FROM scored GROUP BY model, score),
cum AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER m)::BIGINT AS positives, (sum(neg) OVER m)::BIGINT AS negatives,
  lead(pos) OVER o AS npos, lead(neg) OVER o AS nneg, row_number() OVER o AS rn FROM hist
  WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), m AS (PARTITION BY model), o AS (PARTITION BY model ORDER BY score DESC)),
points AS (SELECT model, score AS threshold, tp, fp, pos, neg, positives, negatives FROM cum WHERE rn = 1 OR npos IS NULL OR NOT (npos = pos AND nneg = neg)
  UNION ALL SELECT model, 'inf'::DOUBLE, 0, 0, 0, 0, sum(pos)::BIGINT, sum(neg)::BIGINT FROM hist GROUP BY model),
area AS (SELECT model, any_value(positives) AS positives, any_value(negatives) AS negatives, sum(neg::HUGEINT * (2 * tp - pos))::DOUBLE / (2 * any_value(positives)::DOUBLE * any_value(negatives)) AS roc_auc FROM cum GROUP BY model),
youden AS (SELECT * FROM points QUALIFY row_number() OVER (PARTITION BY model ORDER BY tp::HUGEINT * negatives - fp::HUGEINT * positives DESC, threshold DESC) = 1),
quality AS (SELECT model, threshold, (tp - pos + negatives - (fp - neg))::DOUBLE / (positives + negatives) AS accuracy,
  CASE WHEN tp - pos + fp - neg = 0 THEN 0.0 ELSE (tp - pos)::DOUBLE / (tp - pos + fp - neg) END AS precision FROM points)"""

FINITE = "CASE WHEN isinf({0}) THEN NULL ELSE round({0}, 6) END"


def roc_query(ctes: str) -> str:
    return f"WITH {ctes}, {POINTS} SELECT model, {FINITE.format('threshold')} AS threshold, tp, fp, round(tp::DOUBLE / positives, 6) AS tpr, round(fp::DOUBLE / negatives, 6) AS fpr FROM points"


def auc_query(ctes: str) -> str:
    return f"WITH {ctes}, {POINTS} SELECT model, positives, negatives, round(roc_auc, 6) AS roc_auc FROM area"


def youden_query(ctes: str) -> str:
    return f"WITH {ctes}, {POINTS} SELECT model, {FINITE.format('threshold')} AS threshold, round(tp::DOUBLE / positives - fp::DOUBLE / negatives, 6) AS youden FROM youden"


def _best(name: str) -> str:
    return f"(SELECT model, CASE WHEN {name} > 0 THEN threshold ELSE 0 END AS threshold, greatest({name}, 0) AS {name} FROM quality QUALIFY row_number() OVER (PARTITION BY model ORDER BY {name} DESC, threshold DESC) = 1)"


def best_query(ctes: str, name: str) -> str:
    return f"WITH {ctes}, {POINTS} SELECT model, {FINITE.format('threshold')} AS threshold, round({name}, 6) AS {name} FROM {_best(name)}"


def _share(a: str, b: str) -> str:
    return f"round(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a})::DOUBLE / ({b}) END, 6)"


METRICS = (
    f"{_share('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_share('tp', 'tp + fp')} AS precision, {_share('tp', 'tp + fn')} AS recall, {_share('2 * tp', '2 * tp + fp + fn')} AS f1_score"
)


def metrics_query(ctes: str) -> str:
    return f"WITH {ctes} SELECT *, {METRICS} FROM c"


def evaluate_query(ctes: str) -> str:
    return f"""WITH {ctes}, {POINTS}, c AS (SELECT model, threshold, tp - pos AS tp, fp - neg AS fp, negatives - (fp - neg) AS tn, positives - (tp - pos) AS fn FROM youden)
SELECT c.model, 'OK' AS status, {METRICS}, round(roc_auc, 6) AS roc_auc, round(b.accuracy, 6) AS best_accuracy, {FINITE.format('c.threshold')} AS threshold, {FINITE.format('b.threshold')} AS best_accuracy_threshold
FROM c JOIN area ON area.model = c.model JOIN {_best('accuracy')} b ON b.model = c.model"""


def sweep_query(ctes: str, thresholds: list[int], score: str) -> str:
    values = ", ".join(f"({float(t)}::DOUBLE)" for t in thresholds)
    return f"""WITH {ctes}, c AS (SELECT threshold, {CELLS} FROM (SELECT t.threshold, label, CAST({score} >= t.threshold AS INTEGER) AS p FROM line_scores, (VALUES {values}) t(threshold)) GROUP BY threshold)
SELECT *, {METRICS} FROM c"""


# String ratios: longest common subsequences of need(a, b) by a recursive table, a row a character

RATIOS = """lcs_rows AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda x: 0::BIGINT) AS r FROM need
  UNION ALL
  SELECT a, b, i + 1, list_concat([0::BIGINT], list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: greatest(r[k + 1], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN r[k] + 1 ELSE 0 END))))) FROM lcs_rows WHERE i < length(a)),
rat AS (SELECT a, b, CAST(CASE WHEN a = b THEN 100 WHEN length(a) = 0 OR length(b) = 0 THEN 0 ELSE round_even(200.0::DOUBLE * r[length(b) + 1] / (length(a) + length(b)), 0) END AS INTEGER) AS score
  FROM lcs_rows WHERE i = length(a))"""

PREP = r"trim(lower(regexp_replace({0}, '\W', ' ', 'g')))"
TOKENS = r"list_filter(string_split_regex(" + PREP + r", '\s+'), lambda t: t <> '')"
PAIRS = "pairs AS (SELECT DISTINCT fraudulent_name AS x, real_name AS y FROM name_pairs)"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({TOKENS.format(x)}), ' ')"


#: Token sets of pairs(x, y): shared tokens, and these with each side's rest.
SETS = f"""toks AS (SELECT x, y, list_distinct({TOKENS.format('x')}) AS tx, list_distinct({TOKENS.format('y')}) AS ty FROM pairs),
sets AS (SELECT x, y, len(tx) = 0 OR len(ty) = 0 AS bare, array_to_string(list_sort(list_intersect(tx, ty)), ' ') AS s,
  array_to_string(list_sort(list_filter(tx, lambda t: NOT list_contains(ty, t))), ' ') AS dx, array_to_string(list_sort(list_filter(ty, lambda t: NOT list_contains(tx, t))), ' ') AS dy FROM toks),
trio AS (SELECT x, y, bare, s, trim(s || ' ' || dx) AS sx, trim(s || ' ' || dy) AS sy FROM sets),
set_need AS (SELECT s AS a, sx AS b FROM trio UNION SELECT s, sy FROM trio UNION SELECT sx, sy FROM trio)"""
SET_SCORES = """set_scores AS (SELECT x, y, CASE WHEN bare THEN 0 ELSE greatest(p.score, q.score, o.score) END AS score FROM trio
  JOIN rat p ON p.a = s AND p.b = sx JOIN rat q ON q.a = s AND q.b = sy JOIN rat o ON o.a = sx AND o.b = sy)"""
SORTS = f"sorts AS (SELECT x, y, {_sorted('x')} AS a, {_sorted('y')} AS b FROM pairs)"
WINDOWS = """ends AS (SELECT x, y, CASE WHEN length(x) <= length(y) THEN x ELSE y END AS a, CASE WHEN length(x) <= length(y) THEN y ELSE x END AS l FROM pairs),
windows AS (SELECT x, y, a, substr(l, i, length(a)) AS b FROM (SELECT *, unnest(range(1, length(l) + 1)) AS i FROM ends))"""


def ratio_query(names: str) -> str:
    return f"WITH RECURSIVE {names}, {PAIRS}, need AS (SELECT x AS a, y AS b FROM pairs), {RATIOS} SELECT a AS fraudulent_name, b AS real_name, score FROM rat"


def token_sort_query(names: str) -> str:
    return f"WITH RECURSIVE {names}, {PAIRS}, {SORTS}, need AS (SELECT DISTINCT a, b FROM sorts), {RATIOS} SELECT x AS fraudulent_name, y AS real_name, score FROM sorts JOIN rat USING (a, b)"


def token_set_query(names: str) -> str:
    return f"WITH RECURSIVE {names}, {PAIRS}, {SETS}, need AS (SELECT DISTINCT a, b FROM set_need), {RATIOS}, {SET_SCORES} SELECT x AS fraudulent_name, y AS real_name, score FROM set_scores"


def partial_query(names: str) -> str:
    return f"WITH RECURSIVE {names}, {PAIRS}, {WINDOWS}, need AS (SELECT DISTINCT a, b FROM windows), {RATIOS} SELECT x AS fraudulent_name, y AS real_name, max(score) AS score FROM windows JOIN rat USING (a, b) GROUP BY x, y"


def _features(names: str, more: str = "") -> str:
    return f"""WITH RECURSIVE {names}, {PAIRS}, {SORTS}, {SETS}, {WINDOWS}, need AS (SELECT a, b FROM sorts UNION SELECT a, b FROM set_need UNION SELECT a, b FROM windows{more}), {RATIOS}, {SET_SCORES},
best AS (SELECT x, y, max(score) AS score FROM windows JOIN rat USING (a, b) GROUP BY x, y),
feats AS (SELECT x AS fraudulent_name, y AS real_name, CAST(levenshtein(x, y) AS INTEGER) AS lev_dist, round(t.score / 100.0::DOUBLE, 6) AS token_set_ratio, round(w.score / 100.0::DOUBLE, 6) AS partial_ratio,
  round(rat.score / 100.0::DOUBLE, 6) AS token_sort_ratio FROM sorts JOIN rat USING (a, b) JOIN set_scores t USING (x, y) JOIN best w USING (x, y))"""


def features_query(names: str) -> str:
    return f"{_features(names)} SELECT * FROM feats"


def scorers_query(names: str) -> str:
    rest = {"token-set": "token_set_ratio", "token-sort": "token_sort_ratio", "partial": "partial_ratio"}
    parts = [f"SELECT fraudulent_name, real_name, '{k}' AS scorer, {c} AS score FROM feats" for k, c in rest.items()]
    parts.append(f"SELECT fraudulent_name, real_name, 'levenshtein', round({LEV_SIM}, 6) FROM feats")
    parts.append("SELECT a, b, 'ratio', round(score / 100.0::DOUBLE, 6) FROM rat JOIN pairs ON x = a AND y = b")
    return f"{_features(names, ' UNION SELECT x, y FROM pairs')} {' UNION ALL '.join(parts)}"


def feature_ranges_query(names: str) -> str:
    parts = [f"SELECT '{c}' AS feature, min({c})::DOUBLE AS least, max({c})::DOUBLE AS most FROM feats" for c in ("lev_dist", "token_set_ratio", "partial_ratio", "token_sort_ratio")]
    return f"{_features(names)} {' UNION ALL '.join(parts)}"


def extracted_query(names: str) -> str:
    return f"""WITH RECURSIVE {names}, raw AS (SELECT DISTINCT fraudulent_name, real_name, translate(fraudulent_name, '0135', 'oles') AS extracted FROM name_pairs),
pairs AS (SELECT DISTINCT lower(extracted) AS x, lower(real_name) AS y FROM raw), {SETS}, need AS (SELECT DISTINCT a, b FROM set_need), {RATIOS}, {SET_SCORES}
SELECT fraudulent_name, real_name, extracted, score FROM raw JOIN set_scores ON x = lower(extracted) AND y = lower(real_name)"""


def lookup_query(refs: str) -> str:
    return f"""WITH RECURSIVE {refs}, kinds AS (SELECT p_type AS ref_name, min(p_partkey) AS ref_id FROM part GROUP BY p_type),
pairs AS (SELECT DISTINCT lower(query_name) AS x, lower(ref_name) AS y FROM queries, kinds), {SETS}, need AS (SELECT DISTINCT a, b FROM set_need), {RATIOS}, {SET_SCORES},
best AS (SELECT query_id AS text_id, arg_max(ref_name, (score, -ref_id)) AS m, max(score) AS score FROM queries, kinds JOIN set_scores ON x = lower(query_name) AND y = lower(ref_name) GROUP BY query_id)
SELECT text_id, CASE WHEN score > 0 THEN m END AS best_match, score, score > 0 AND score >= 40 AS is_match FROM best"""


# Character n-grams of queries(query_id, query_name) and refs(ref_id, ref_name)


def _grams(source: str, key: str, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, substr(t, i, {k}) AS gram FROM (SELECT {key}, lower({name}) AS t, unnest(range(1, length({name}) - {k} + 2)) AS i FROM {source})" for k in (3, 4, 5)
    )


def _weights(source: str, key: str) -> str:
    return f"""(WITH c AS (SELECT {key}, gram, count(*) AS tf FROM {source} GROUP BY {key}, gram), w AS (SELECT {key}, gram, tf * idf AS raw FROM c JOIN idf USING (gram)),
  n AS (SELECT {key}, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY {key}) SELECT {key}, gram, raw / norm AS weight FROM w JOIN n USING ({key}))"""


TFIDF = f"""rg AS ({_grams('refs', 'ref_id', 'ref_name')}), qg AS ({_grams('queries', 'query_id', 'query_name')}),
idf AS (SELECT gram, ln((1.0::DOUBLE + (SELECT count(*) FROM refs)) / (1.0::DOUBLE + count(DISTINCT ref_id))) + 1.0 AS idf FROM rg GROUP BY gram),
q AS {_weights('qg', 'query_id')}, r AS {_weights('rg', 'ref_id')}"""
TFIDF_TOP = """sc AS (SELECT query_id, ref_id, round(sum(q.weight * r.weight), 9) AS cosine FROM q JOIN r ON q.gram = r.gram GROUP BY query_id, ref_id),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, ref_id) AS rank FROM sc) WHERE rank <= greatest(1, (SELECT count(*) FROM refs) * 5 // 100))"""


# The projection head with weights by a rule


def head_ctes(dim: int, hidden: int, out: int, source: str, name: str) -> str:
    row = lambda j, m, k: f"list_transform(range({m}), lambda i: (({j} * 5 + i * 3 + {k}) % 7 - 3) / 8.0::DOUBLE)"
    first = f"list_transform(range({hidden}), lambda j: greatest(list_dot_product({row('j', dim, 0)}, x) + ((j * 5 + 1) % 7 - 3) / 8.0::DOUBLE, 0.0::DOUBLE))"
    second = f"list_transform(range({out}), lambda o: list_dot_product({row('o', hidden, 2)}, h) + ((o * 5 + 3) % 7 - 3) / 8.0::DOUBLE)"
    return f"{name} AS MATERIALIZED (SELECT id, {second} AS v FROM (SELECT id, {first} AS h FROM ({source})))"


def head_step(dim: int, hidden: int, out: int, lr: float, margin: float = 1.0) -> str:
    """Weights of the head by a rule after one step of plain descent on the mean contrastive loss of
    vec_pairs(pair_id, fraud_emb, real_emb, label): forward, backward and update spelled out."""
    row = lambda j, m, k: f"list_transform(range({m}), lambda i: (({j} * 5 + i * 3 + {k}) % 7 - 3) / 8.0::DOUBLE)"
    at = lambda j, i, k: f"(({j} * 5 + {i} * 3 + {k}) % 7 - 3) / 8.0::DOUBLE"
    layer1 = lambda x: f"list_transform(range({hidden}), lambda j: greatest(list_dot_product({row('j', dim, 0)}, {x}) + ((j * 5 + 1) % 7 - 3) / 8.0::DOUBLE, 0.0::DOUBLE))"
    layer2 = lambda h: f"list_transform(range({out}), lambda o: list_dot_product({row('o', hidden, 2)}, {h}) + ((o * 5 + 3) % 7 - 3) / 8.0::DOUBLE)"
    return f"""
hid AS MATERIALIZED (SELECT label, fraud_emb AS x, real_emb AS y, {layer1("fraud_emb")} AS hx, {layer1("real_emb")} AS hy FROM vec_pairs),
proj AS MATERIALIZED (SELECT *, {layer2("hx")} AS px, {layer2("hy")} AS py FROM hid),
unit AS (SELECT *, sqrt(list_dot_product(px, px)) AS nx, sqrt(list_dot_product(py, py)) AS ny FROM proj),
dist AS MATERIALIZED (SELECT *, list_transform(range(1, {out + 1}), lambda o: px[o] / nx) AS ux, list_transform(range(1, {out + 1}), lambda o: py[o] / ny) AS uy FROM unit),
gap AS (SELECT *, list_transform(range(1, {out + 1}), lambda o: ux[o] - uy[o]) AS diff FROM dist),
slope AS (SELECT *, sqrt(list_dot_product(diff, diff)) AS d FROM gap),
pull AS MATERIALIZED (SELECT *, list_transform(diff, lambda v: v * (2 * label * d - 2 * (1 - label) * greatest({margin} - d, 0)) / greatest(d, 1e-12)) AS g FROM slope),
back AS MATERIALIZED (
  SELECT x AS z, hx AS h, list_transform(range(1, {out + 1}), lambda o: (g[o] - ux[o] * list_dot_product(g, ux)) / nx) AS gp FROM pull UNION ALL
  SELECT y, hy, list_transform(range(1, {out + 1}), lambda o: (-g[o] + uy[o] * list_dot_product(g, uy)) / ny) FROM pull),
deep AS MATERIALIZED (SELECT z, h, gp, list_transform(range({hidden}), lambda j: CASE WHEN h[j + 1] > 0 THEN list_sum(list_transform(range({out}), lambda o: gp[o + 1] * ({at("o", "j", 2)}))) ELSE 0.0::DOUBLE END) AS gh FROM back),
n AS (SELECT count(*) AS n FROM vec_pairs),
grads AS (
  SELECT 'w1' AS name, j * {dim} + i AS slot, {at("j", "i", 0)} AS old, sum(gh[j + 1] * z[i + 1]) AS g FROM deep, range({hidden}) a(j), range({dim}) b(i) GROUP BY j, i UNION ALL
  SELECT 'b1', j, {at("j", "0", 1)}, sum(gh[j + 1]) FROM deep, range({hidden}) a(j) GROUP BY j UNION ALL
  SELECT 'w2', o * {hidden} + j, {at("o", "j", 2)}, sum(gp[o + 1] * h[j + 1]) FROM deep, range({out}) a(o), range({hidden}) b(j) GROUP BY o, j UNION ALL
  SELECT 'b2', o, {at("o", "0", 3)}, sum(gp[o + 1]) FROM deep, range({out}) a(o) GROUP BY o)
SELECT name, slot::INTEGER AS slot, round(old - {lr} * g / n, 6) AS weight FROM grads, n"""


def gram_pairs_query(pairs: str) -> str:
    grams = " UNION ".join(f"SELECT name, substr(t, i, {k}) AS gram FROM (SELECT name, t, unnest(range(1, length(t) - {k} + 2)) AS i FROM marked)" for k in (1, 2))
    return f"""WITH {pairs}, names AS (SELECT fraudulent_name AS name FROM name_pairs UNION SELECT real_name FROM name_pairs),
marked AS (SELECT name, '^' || lower(name) || '$' AS t FROM names), grams AS ({grams}),
together AS (SELECT a.gram, b.gram AS other, count(*) AS n FROM grams a JOIN grams b ON a.name = b.name GROUP BY 1, 2),
own AS (SELECT gram, n FROM together WHERE gram = other),
weighed AS (SELECT t.*, ln(t.n * (SELECT count(*) FROM names)::DOUBLE / (a.n * b.n)) AS w FROM together t JOIN own a ON a.gram = t.gram JOIN own b ON b.gram = t.other)
SELECT gram, other, n, CASE WHEN w > 0 THEN round(w, 6) END AS weight FROM weighed"""
