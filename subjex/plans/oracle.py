"""Oracle SQL (DuckDB dialect) for the registered queries: the same
definitions written independently as plain SQL, brute force where the Spark
plan is clever (the PR grid evaluates every cell directly here)."""

from __future__ import annotations

from subjex.plans.fixtures import (ANSWERS_SQL, DATASET_SQL, DOCS_SQL, GOLD_SQL, MEMBERS_SQL,
                                   PRED_SQL, RANK_INPUT_SQL, RESP_SQL, STRATA_SQL, VEC_Q_SQL, VEC_V_SQL,
                                   EXAMPLES_SQL, LETTERS, TRIPLES_SQL, PREF_LABEL, ALT_LABEL)
from subjex.operators.prompts import CHATML


def _lit(s: str) -> str:
    """A SQL string literal with newlines spelled as chr(10)."""
    parts = s.replace("'", "''").split("\n")
    return " || chr(10) || ".join(f"'{p}'" for p in parts)


CHATML_SQL = {k: _lit(v) for k, v in CHATML.items()}
CHATML_SQL["head"] = _lit(CHATML["instruction"].replace("{custom_instruction}", "Nenne treffende Begriffe"))


def s9(x: str) -> str:
    return f"(floor(({x}) * 1e9 + 0.5) / 1e9)"


def r6(x: str) -> str:
    return f"(floor(floor(({x}) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0)"


def knn_sql(q_sql: str, v_sql: str, k: int) -> str:
    return f"""
SELECT q.query_id, v.label_id, v.label_text, list_cosine_similarity(q.embedding, v.embedding) AS cosine
FROM ({q_sql}) q CROSS JOIN ({v_sql}) v
QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY cosine DESC, v.label_id) <= {k}
"""


def bm25_sql(q_sql: str, c_sql: str, k: int, k1: float = 1.2, b: float = 0.75) -> str:
    """BM25 written out: tf, dl, df, idf; distinct query tokens."""
    split = "'[^\\p{L}\\p{N}]+'"
    return f"""
WITH c AS ({c_sql}),
ct AS (SELECT label_id, unnest(regexp_split_to_array(lower(label_text), {split})) AS token FROM c),
tf AS (SELECT label_id, token, count(*) AS tf FROM ct WHERE token <> '' GROUP BY ALL),
dl AS (SELECT label_id, sum(tf) AS dl FROM tf GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM c),
av AS (SELECT CAST(sum(dl) AS DOUBLE) / (SELECT n FROM nn) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w AS (SELECT tf.label_id, tf.token,
             ln(1 + ((SELECT n FROM nn) - df.df + 0.5) / (df.df + 0.5)) * tf.tf * ({k1} + 1)
             / (tf.tf + {k1} * (1 - {b} + {b} * dl.dl / (SELECT avgdl FROM av))) AS weight
      FROM tf JOIN dl USING (label_id) JOIN df USING (token)),
qt AS (SELECT DISTINCT query_id, token FROM (
         SELECT query_id, unnest(regexp_split_to_array(lower(query), {split})) AS token FROM ({q_sql}))
       WHERE token <> ''),
s AS (SELECT query_id, label_id, sum(weight) AS score FROM qt JOIN w USING (token) GROUP BY ALL)
SELECT query_id, label_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {s9('score')} DESC, label_id) <= {k}
"""


TEXTQ_SQL = "SELECT item_id AS query_id, text AS query FROM benchmark"
TEXTC_SQL = "SELECT CAST(doc_id AS VARCHAR) AS label_id, text AS label_text FROM documents"
HY_ITEMS = ("SELECT e.vec_id AS item_id, e.label, CAST(e.embedding AS DOUBLE[]) AS embedding, d.text "
            "FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id")
HY_Q = f"SELECT item_id AS query_id, embedding, text AS query FROM ({HY_ITEMS}) WHERE label = 0"
HY_V = (f"SELECT CAST(item_id AS VARCHAR) AS label_id, text AS label_text, embedding "
        f"FROM ({HY_ITEMS}) WHERE label <> 0")


def hybrid_sql(alpha: float = 0.7) -> str:
    """Every label row fused for every query: no lists."""
    return f"""
WITH pairs AS (SELECT q.query_id, v.label_id, list_cosine_similarity(q.embedding, v.embedding) AS v FROM ({HY_Q}) q CROSS JOIN ({HY_V}) v),
kw AS ({bm25_sql(HY_Q, HY_V, 10 ** 9)}),
scaled AS (
  SELECT p.query_id, p.label_id, v AS cosine,
         CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) ELSE 1.0 END AS vector,
         CASE WHEN max(kw.score) OVER w > 0 THEN coalesce(kw.score, 0.0) / max(kw.score) OVER w ELSE 0.0 END AS keyword
  FROM pairs p LEFT JOIN kw ON kw.query_id = p.query_id AND kw.label_id = p.label_id WINDOW w AS (PARTITION BY p.query_id)),
fused AS (SELECT *, {alpha} * vector + {round(1 - alpha, 10)} * keyword AS hybrid_score FROM scaled),
best AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {s9('hybrid_score')} DESC, label_id) = 1)
SELECT query_id, label_id, label_text AS term, {r6('hybrid_score')} AS hybrid_score, {r6('cosine')} AS cosine
FROM best JOIN ({HY_V}) v USING (label_id)
"""


BEST_MATCH_SQL = f"""
WITH p AS ({PRED_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY model, prompt, doc_id, label_id
                                   ORDER BY cosine_similarity DESC, candidate DESC) AS rn,
             max(cosine_similarity) OVER (PARTITION BY model, prompt, doc_id, label_id) AS mc,
             max(hybrid_score) OVER (PARTITION BY model, prompt, doc_id, label_id) AS mh
      FROM p)
SELECT model, prompt, doc_id, label_id, candidate, term, mc AS cosine_similarity, mh AS hybrid_score
FROM r WHERE rn = 1
"""

def vote_sql(members_sql: str) -> str:
    return f"""
WITH b AS ({BEST_MATCH_SQL}),
m AS (SELECT *, count(*) OVER (PARTITION BY ensemble) AS n FROM ({members_sql}))
SELECT m.ensemble, b.doc_id, b.label_id,
       (floor(floor((sum(greatest(0.0, least(1.0, b.cosine_similarity))) / any_value(m.n)) * 1e9 + 0.5) / 1e9 * 1000000000.0 + 0.5) / 1000000000.0) AS score,
       arg_max(b.term, m.ord) AS term,
       max(b.hybrid_score) AS hybrid_score, max(b.cosine_similarity) AS cosine_similarity,
       count(*) AS count
FROM b JOIN m USING (model, prompt)
GROUP BY m.ensemble, b.doc_id, b.label_id
"""


VOTE_SQL = vote_sql(MEMBERS_SQL)

RANKED_SQL = f"""
WITH a AS (SELECT doc_id, term,
                  CASE WHEN regexp_replace(coalesce(answer, ''), '[^0-9]', '', 'g') = '' THEN 0.0
                       ELSE CAST(regexp_replace(answer, '[^0-9]', '', 'g') AS DOUBLE) END AS relevance
           FROM ({ANSWERS_SQL})),
acc AS (SELECT * FROM a WHERE relevance >= 0
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY term) <= 50),
lab AS (SELECT doc_id, term, max(label_id) AS label_id FROM ({RANK_INPUT_SQL}) GROUP BY doc_id, term),
j AS (SELECT acc.doc_id, lab.label_id, acc.relevance FROM acc JOIN lab USING (doc_id, term))
SELECT doc_id, label_id,
       max(coalesce(relevance / nullif((SELECT max(relevance) FROM j), 0), 0.0)) AS score
FROM j GROUP BY doc_id, label_id
"""



def _set_scores_sql(pred_sql: str, by: str, strata: bool, micro: bool = False) -> str:
    """Per-document CTE then averages; gold documents drive recall and F1."""
    bycols = by + ", " if by else ""
    doc = f"""
WITH p AS (SELECT DISTINCT {bycols}doc_id, label_id FROM ({pred_sql})),
g AS ({GOLD_SQL}),
gd AS (SELECT doc_id, count(*) AS n_gold, any_value(language) AS language, any_value(text_type) AS text_type
       FROM g GROUP BY doc_id),
pd AS (SELECT {bycols}p.doc_id, count(*) AS n_pred, count(g.label_id) AS tp
       FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.label_id = g.label_id
       GROUP BY ALL),
d AS (SELECT pd.*, gd.n_gold, gd.language, gd.text_type FROM pd JOIN gd USING (doc_id))
"""
    sets = ["(language, text_type)", "(language)", "(text_type)", "()"] if strata else ["()"]
    out = []
    for s in sets:
        cols = [c.strip() for c in s.strip("()").split(",") if c.strip()]
        lang = "language" if "language" in cols else "'all'"
        tt = "text_type" if "text_type" in cols else "'all'"
        gkeys = ", ".join(([by] if by else []) + cols)
        group = f"GROUP BY {gkeys}" if gkeys else ""
        if micro:
            out.append(f"""
SELECT {bycols}{lang} AS language, {tt} AS text_type,
       CAST(sum(tp) AS DOUBLE) AS s_tp, sum(n_pred) AS s_pred
FROM d x {group}""")
        else:
            out.append(f"""
SELECT {bycols}{lang} AS language, {tt} AS text_type,
       sum(CAST(tp AS DOUBLE) / n_pred) AS s_prec, sum(CAST(tp AS DOUBLE) / n_gold) AS s_rec,
       sum(2.0 * tp / (n_pred + n_gold)) AS s_f1, sum(CAST(tp AS DOUBLE) / least(n_gold, n_pred)) AS s_rprec,
       count(*) AS n_has
FROM d x {group}""")
    body = doc + ", s AS (" + " UNION ALL ".join(out) + ")"
    strata_filter = "" if strata else "WHERE language = 'all' AND text_type = 'all'"
    keys = f"(SELECT DISTINCT {by} FROM d)" if by else "(SELECT 1 AS one)"
    body += f""",
nd AS (SELECT coalesce(language, 'all') AS language, coalesce(text_type, 'all') AS text_type, count(*) AS n_docs
       FROM gd GROUP BY CUBE (language, text_type)),
st AS (SELECT * FROM nd {strata_filter}),
allst AS (SELECT k.*, st.* FROM {keys} k CROSS JOIN st),
j AS (SELECT allst.*, s.* EXCLUDE ({bycols}language, text_type)
      FROM allst LEFT JOIN s USING ({bycols}language, text_type))
"""
    if micro:
        return body + f"""
SELECT {bycols}metric, value, language, text_type FROM (
  SELECT {bycols}language, text_type,
         coalesce(s_tp, 0) / nullif(coalesce(s_pred, 0), 0) AS p,
         coalesce(s_tp, 0) / (SELECT CAST(sum(n_gold) AS DOUBLE) FROM gd) AS r,
         coalesce(s_tp, 0) / least((SELECT sum(n_gold) FROM gd), nullif(coalesce(s_pred, 0), 0)) AS rp
  FROM j)
CROSS JOIN LATERAL (VALUES ('prec', p), ('rec', r), ('f1', 2 * p * r / nullif(p + r, 0)), ('rprec', rp)) v(metric, value)
"""
    return body + f"""
SELECT {bycols}metric, value, language, text_type FROM (
  SELECT {bycols}language, text_type, n_docs, coalesce(s_prec, 0.0) AS s_prec, coalesce(s_rec, 0.0) AS s_rec,
         coalesce(s_f1, 0.0) AS s_f1, coalesce(s_rprec, 0.0) AS s_rprec, coalesce(n_has, 0) AS n_has FROM j)
CROSS JOIN LATERAL (VALUES ('prec', s_prec / nullif(n_has, 0)), ('rec', s_rec / n_docs), ('f1', s_f1 / n_docs),
                           ('rprec', s_rprec / nullif(n_has, 0))) v(metric, value)
"""


def _wrap_round(sql: str, keep: list[str], dbl: list[str]) -> str:
    cols = keep + [f"(floor(floor(({c}) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS {c}" for c in dbl]
    return f"SELECT {', '.join(cols)} FROM ({sql})"


def _grid_sql(pred_sql: str, by: str, gold_sql: str = GOLD_SQL) -> str:
    """Brute force: each prediction of a gold document goes to every cell (threshold i/100, limit) that keeps it."""
    return f"""
WITH p AS (SELECT {by}, doc_id, label_id, max({s9('score')}) AS score FROM ({pred_sql})
           WHERE score IS NOT NULL GROUP BY ALL),
g AS (SELECT DISTINCT doc_id, label_id FROM ({gold_sql})),
gd AS (SELECT doc_id, count(*) AS n_gold FROM g GROUP BY doc_id),
nd AS (SELECT count(*) AS n FROM gd),
r AS (SELECT p.*, rank() OVER (PARTITION BY {by}, p.doc_id ORDER BY p.score DESC) AS rk,
             CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS hit
      FROM p LEFT JOIN g ON p.doc_id = g.doc_id AND p.label_id = g.label_id),
mp AS (SELECT {by}, max(c) AS mx FROM (SELECT {by}, doc_id, count(*) AS c FROM p GROUP BY ALL) GROUP BY ALL),
lims AS (SELECT {by}, unnest(generate_series(1, mx)) AS lim FROM mp),
cells AS (SELECT lims.*, t.i FROM lims CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS i) t),
rj AS (SELECT {by}, doc_id, score, rk, hit, n_gold FROM r JOIN gd USING (doc_id)),
en AS MATERIALIZED (SELECT rj.*, unnest(generate_series(rk, mx)) AS lim FROM rj JOIN mp USING ({by})),
ei AS (SELECT en.*, unnest(generate_series(0, CAST(least(100, floor(greatest(score, -0.01) * 100) + 1) AS INT))) AS i FROM en),
per AS (SELECT {by}, i, lim, doc_id, any_value(n_gold) AS n_gold, count(*) AS n_ret, sum(hit) AS tp
        FROM ei WHERE score >= CAST(i AS DOUBLE) / 100 GROUP BY ALL),
agg AS (SELECT {by}, i, lim, sum(CAST(tp AS DOUBLE) / n_ret) AS sp, count(*) AS nh,
               sum(CAST(tp AS DOUBLE) / n_gold) AS sr, sum(2.0 * tp / (n_ret + n_gold)) AS sf
        FROM per GROUP BY ALL)
SELECT {', '.join(f'c.{k}' for k in by.split(', '))}, CAST(c.i AS DOUBLE) / 100 AS threshold, c.lim AS "limit",
       agg.sp / agg.nh AS precision,
       coalesce(agg.sr, 0.0) / (SELECT n FROM nd) AS recall,
       coalesce(agg.sf, 0.0) / (SELECT n FROM nd) AS f1
FROM cells c LEFT JOIN agg ON {' AND '.join(f'c.{k} = agg.{k}' for k in by.split(', '))}
     AND c.i = agg.i AND c.lim = agg.lim
"""


def _auc_sql(grid_sql: str, by: str) -> str:
    return f"""
WITH pts AS (SELECT {by}, (floor(floor((recall) * 1e9 + 0.5) / 1e9 * 1000000000.0 + 0.5) / 1000000000.0) AS recall, max((floor(floor((precision) * 1e9 + 0.5) / 1e9 * 1000000000.0 + 0.5) / 1000000000.0)) AS precision
             FROM ({grid_sql}) WHERE precision IS NOT NULL GROUP BY ALL),
cm AS (SELECT {by}, recall, max(precision) OVER (PARTITION BY {by} ORDER BY recall DESC
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pc FROM pts),
ar AS (SELECT {by}, (recall - coalesce(lag(recall) OVER (PARTITION BY {by} ORDER BY recall), 0.0)) * pc AS a FROM cm)
SELECT {by}, sum(a) AS pr_auc FROM ar GROUP BY ALL
"""


MEMBER_PRED = f"SELECT model, prompt, doc_id, label_id, score FROM ({PRED_SQL})"
GRID = _grid_sql(MEMBER_PRED, "model, prompt")
VOTE_PRED = f"SELECT ensemble, doc_id, label_id, score FROM ({VOTE_SQL})"


#: members are (return flag, line status): three by two; they go by their place in name order, labels by their number
MAX_MEMBERS = 6
LABEL_NUMBER = "CAST(substr(label_id, 5) AS BIGINT)"
GREEDY_GOLD = f"SELECT doc_id, {LABEL_NUMBER} AS label_id FROM ({GOLD_SQL})"
GREEDY_NAMES = f"""
SELECT name, row_number() OVER (ORDER BY name) AS member FROM (SELECT DISTINCT model || '_' || prompt AS name FROM ({PRED_SQL}))"""
GREEDY_SCORES = f"""
SELECT member, doc_id, {LABEL_NUMBER} AS label_id, max({s9('score')}) AS score
FROM ({PRED_SQL}) JOIN names ON name = model || '_' || prompt WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL"""


def _area_of(cte: str) -> str:
    return _auc_sql(_grid_sql(f"SELECT candidate, doc_id, label_id, score FROM {cte}", "candidate", GREEDY_GOLD), "candidate")


def _round_sql(k: int, candidates: str) -> list[str]:
    """Round k: candidate sets, their areas, the pick and the names that remain."""
    return [f"c{k} AS MATERIALIZED ({candidates})", f"a{k} AS MATERIALIZED ({_area_of(f'c{k}')})",
            f"p{k} AS MATERIALIZED (SELECT candidate, pr_auc FROM a{k} ORDER BY {s9('pr_auc')} DESC, candidate LIMIT 1)",
            f"n{k + 1} AS MATERIALIZED (SELECT member FROM n{k} WHERE member NOT IN (SELECT candidate FROM p{k}))"]


def _greedy_start() -> list[str]:
    return [f"names AS MATERIALIZED ({GREEDY_NAMES})", f"m AS MATERIALIZED ({GREEDY_SCORES})", "n0 AS MATERIALIZED (SELECT DISTINCT member FROM m)"]


def greedy_forward_sql() -> str:
    """Every round written out: each remaining member's set is the plain mean of the picks and itself."""
    ctes = _greedy_start()
    for k in range(MAX_MEMBERS):
        picks = " UNION ALL ".join(f"SELECT candidate FROM p{j}" for j in range(k)) or "SELECT NULL WHERE FALSE"
        ctes += _round_sql(k, f"""
SELECT n.member AS candidate, m.doc_id, m.label_id, sum(m.score) / {k + 1} AS score
FROM n{k} n JOIN m ON m.member = n.member OR m.member IN ({picks}) GROUP BY ALL""")
    rows = " UNION ALL ".join(f"SELECT name AS model_prompt, {r6('pr_auc')} AS cum_score FROM p{k} JOIN names ON member = candidate" for k in range(MAX_MEMBERS))
    return f"WITH {', '.join(ctes)} {rows}"


def greedy_recurrent_sql() -> str:
    """Every round written out over the members' own tables: each remaining one is fused with the pick's with weight n."""
    ctes = _greedy_start()
    tables = "SELECT member AS candidate, doc_id, label_id, score FROM m"
    for k in range(MAX_MEMBERS):
        ctes += _round_sql(k, tables)
        tables = f"""
SELECT candidate, doc_id, label_id, sum(part) / {k + 2} AS score FROM (
  SELECT candidate, doc_id, label_id, score AS part FROM c{k} WHERE candidate IN (SELECT member FROM n{k + 1})
  UNION ALL SELECT n.member, doc_id, label_id, {k + 1} * score FROM n{k + 1} n CROSS JOIN (SELECT * FROM c{k} WHERE candidate IN (SELECT candidate FROM p{k})))
GROUP BY ALL"""
    rows = " UNION ALL ".join(f"SELECT name AS model_prompt, {r6('pr_auc')} AS cum_score FROM p{k} JOIN names ON member = candidate" for k in range(MAX_MEMBERS))
    return f"WITH {', '.join(ctes)} {rows}"


def sampled_members_sql(n: int, max_big: int, samples: int, seed: int) -> str:
    """The seeded draws: members by the MD5 sum of "seed|draw|model|prompt", big and small apart."""
    return f"""
WITH ex AS (SELECT DISTINCT model, prompt, model = 'R' AS big FROM ({PRED_SQL})),
c AS (SELECT count(*) FILTER (big) AS nb, count(*) FILTER (NOT big) AS ns FROM ex),
size AS (SELECT nb, CASE WHEN {n - max_big} > ns THEN ns + {max_big} ELSE {n} END AS n FROM c),
quota AS (SELECT n, least({max_big}, nb, n) AS b FROM size),
draws AS (SELECT ex.*, d.draw FROM ex CROSS JOIN (SELECT unnest(generate_series(0, {samples - 1})) AS draw) d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY draw, big ORDER BY md5('{seed}|' || draw || '|' || model || '|' || prompt), model, prompt) AS place FROM draws),
picked AS (SELECT draw, model, prompt FROM ranked, quota WHERE place <= CASE WHEN big THEN b ELSE n - b END),
named AS (SELECT draw, string_agg(model || '_' || prompt, '|' ORDER BY model || '_' || prompt) AS ensemble FROM picked GROUP BY draw)
SELECT ensemble, model, prompt, row_number() OVER (PARTITION BY ensemble ORDER BY model, prompt) AS ord
FROM (SELECT DISTINCT ensemble, model, prompt FROM picked JOIN named USING (draw))
"""


def _best_ensembles_sql(votes: str) -> str:
    area = _auc_sql(_grid_sql(f"SELECT ensemble, doc_id, label_id, score FROM ({votes})", "ensemble"), "ensemble")
    return f"SELECT ensemble, {r6('pr_auc')} AS pr_auc FROM ({area}) ORDER BY {s9('pr_auc')} DESC, ensemble LIMIT 10"


def greedy_backward_sql() -> str:
    """Every round written out: the sum of what remains, less one member, over one member fewer."""
    ctes = [*_greedy_start(), "t0 AS MATERIALIZED (SELECT doc_id, label_id, sum(score) AS s FROM m GROUP BY ALL)",
            "i AS (SELECT 0 AS candidate, doc_id, label_id, s / (SELECT count(*) FROM n0) AS score FROM t0)",
            f"ia AS MATERIALIZED ({_area_of('i')})"]
    for k in range(MAX_MEMBERS - 1):
        ctes += _round_sql(k, f"""
SELECT candidate, doc_id, label_id, score FROM (
  SELECT candidate, doc_id, label_id, greatest(0.0, least(1.0, sum(part) / ((SELECT count(*) FROM n{k}) - 1))) AS score
  FROM (SELECT n.member AS candidate, t.doc_id, t.label_id, t.s AS part FROM n{k} n CROSS JOIN t{k} t
        UNION ALL SELECT m.member, m.doc_id, m.label_id, -m.score FROM n{k} n JOIN m USING (member))
  WHERE (SELECT count(*) FROM n{k}) > 1 GROUP BY ALL)
WHERE abs(score) > 1e-10""")
        ctes.append(f"""t{k + 1} AS MATERIALIZED (
SELECT doc_id, label_id, sum(s) AS s
FROM (SELECT * FROM t{k} UNION ALL SELECT doc_id, label_id, -score FROM m WHERE member IN (SELECT candidate FROM p{k}))
GROUP BY ALL HAVING abs(sum(s)) > 1e-10)""")
    rows = " UNION ALL ".join(f"SELECT name AS model_prompt, {r6('pr_auc')} AS score, (SELECT {r6('pr_auc')} FROM ia) AS initial FROM p{k} JOIN names ON member = candidate"
                              for k in range(MAX_MEMBERS - 1))
    return f"WITH {', '.join(ctes)} {rows}"


#: Whole texts as letter counts of unit length, one row for each dimension (the encoder `fixtures.letter_counts`).
EMBED_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
c AS (SELECT row, doc_id, dim, length(t) - length(replace(t, substr('{LETTERS}', dim + 1, 1), '')) AS x
      FROM d CROSS JOIN (SELECT unnest(generate_series(0, {len(LETTERS) - 1})) AS dim)),
e AS (SELECT *, greatest(sqrt(CAST(sum(x * x) OVER (PARTITION BY row) AS DOUBLE)), 1e-12) AS size FROM c)
SELECT doc_id, CAST(dim AS INTEGER) AS dim, {r6('CAST(CAST(x / size AS FLOAT) AS DOUBLE)')} AS value FROM e
"""


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["q_best_match"] = _wrap_round(BEST_MATCH_SQL, ["model", "prompt", "doc_id", "label_id", "candidate", "term"],
                                    ["cosine_similarity", "hybrid_score"])
    q["q_threshold_split"] = f"""
SELECT model, prompt, doc_id, label_id, candidate, (floor(floor((cosine_similarity) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS cosine_similarity,
       CASE WHEN cosine_similarity >= 0.7 THEN 'kept' ELSE 'removed' END AS side
FROM ({PRED_SQL}) WHERE cosine_similarity IS NOT NULL AND NOT isnan(cosine_similarity)
"""
    q["q_map_stats"] = f"""
WITH p AS ({PRED_SQL}),
a AS (SELECT DISTINCT 'gnd:' || CAST(p_partkey AS VARCHAR) AS nid FROM part WHERE p_size <= 40),
kept AS (SELECT * FROM p WHERE cosine_similarity >= 0.7),
al AS (SELECT * FROM kept WHERE label_id IN (SELECT nid FROM a)),
k AS (SELECT model, prompt, count(*) AS n FROM (SELECT DISTINCT model, prompt, doc_id, label_id FROM al) GROUP BY ALL),
rm AS (SELECT model, prompt, count(*) AS n FROM p WHERE cosine_similarity < 0.7 GROUP BY ALL),
kc AS (SELECT model, prompt, count(*) AS n FROM kept GROUP BY ALL),
ac AS (SELECT model, prompt, count(*) AS n FROM al GROUP BY ALL),
mm AS (SELECT model, prompt FROM k UNION SELECT model, prompt FROM rm)
SELECT mm.model, mm.prompt, CAST(coalesce(k.n, 0) AS BIGINT) AS n_keywords,
       CAST(coalesce(rm.n, 0) AS BIGINT) AS n_matches_below_threshold,
       CAST(kc.n - coalesce(ac.n, 0) AS BIGINT) AS n_not_in_allowed_subjects
FROM mm LEFT JOIN k USING (model, prompt) LEFT JOIN rm USING (model, prompt)
     LEFT JOIN kc USING (model, prompt) LEFT JOIN ac USING (model, prompt)
"""
    q["q_ensemble_vote"] = _wrap_round(VOTE_SQL, ["ensemble", "doc_id", "label_id", "term", "count"],
                                       ["score", "hybrid_score", "cosine_similarity"])
    q["q_combine"] = f"""
WITH e AS (SELECT doc_id, label_id, score FROM ({VOTE_SQL}) WHERE ensemble = 'all'),
r AS ({RANKED_SQL})
SELECT coalesce(e.doc_id, r.doc_id) AS doc_id, coalesce(e.label_id, r.label_id) AS label_id,
       (floor(floor((coalesce(e.score, 0.0)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score_ensemble, (floor(floor((coalesce(r.score, 0.0)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score_relevance,
       (floor(floor((0.3 * coalesce(e.score, 0.0) + 0.7 * coalesce(r.score, 0.0)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score
FROM e FULL OUTER JOIN r ON e.doc_id = r.doc_id AND e.label_id = r.label_id
"""
    q["q_rank_min"] = f"""
SELECT ensemble, doc_id, label_id, (floor(floor((score) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score,
       CAST(rank() OVER (PARTITION BY ensemble, doc_id ORDER BY score DESC) AS INTEGER) AS rank
FROM ({VOTE_PRED})
"""
    q["q_cap_alphabetical"] = f"""
WITH a AS (SELECT doc_id, term,
                  CASE WHEN regexp_replace(coalesce(answer, ''), '[^0-9]', '', 'g') = '' THEN 0.0
                       ELSE CAST(regexp_replace(answer, '[^0-9]', '', 'g') AS DOUBLE) END AS relevance
           FROM ({ANSWERS_SQL}))
SELECT doc_id, term, (floor(floor((relevance) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS relevance FROM a WHERE relevance >= 1
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY term) <= 2
"""
    q["q_relevance_norm"] = f"SELECT doc_id, label_id, (floor(floor((score) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score FROM ({RANKED_SQL})"
    q["q_gold_explode"] = f"""
SELECT DISTINCT doc_id, label_id, language, text_type FROM (
  SELECT doc_id, regexp_extract(piece, '(gnd:[0-9X-]+)', 1) AS label_id, language, text_type
  FROM (SELECT doc_id, unnest(string_split("dcterms:subject", ',')) AS piece, language, text_type
        FROM ({DATASET_SQL})))
WHERE label_id <> ''
"""
    ss = _set_scores_sql(MEMBER_PRED, "model, prompt", strata=False)
    q["q_set_scores"] = f"SELECT model, prompt, metric, (floor(floor((value) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS value, language, text_type FROM ({ss})"
    st = _set_scores_sql(MEMBER_PRED, "model, prompt", strata=True)
    q["q_strata_scores"] = f"SELECT model, prompt, metric, (floor(floor((value) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS value, language, text_type FROM ({st})"
    top5 = f"""SELECT * FROM ({MEMBER_PRED})
QUALIFY rank() OVER (PARTITION BY model, prompt, doc_id ORDER BY score DESC) <= 5"""
    mi = _set_scores_sql(top5, "model, prompt", strata=False, micro=True)
    q["q_micro_f1_at_5"] = f"SELECT model, prompt, metric, (floor(floor((value) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS value FROM ({mi})"
    q["q_pr_grid"] = f"""
SELECT model, prompt, (floor(floor((threshold) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS threshold, "limit", (floor(floor((precision) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS precision,
       (floor(floor((recall) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS recall, (floor(floor((f1) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS f1 FROM ({GRID})
"""
    q["q_pr_auc"] = f"SELECT model, prompt, (floor(floor((pr_auc) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS pr_auc FROM ({_auc_sql(GRID, 'model, prompt')})"
    q["q_opt_cutoff"] = f"""
SELECT model, prompt, (floor(floor((threshold) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS threshold, "limit", (floor(floor((precision) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS precision,
       (floor(floor((recall) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS recall, (floor(floor((f1) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS f1
FROM ({GRID}) WHERE f1 IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY model, prompt ORDER BY (floor(floor((f1) * 1e9 + 0.5) / 1e9 * 1000000000000.0 + 0.5) / 1000000000000.0) DESC, threshold DESC, "limit") = 1
"""
    q["q_pivot_metrics"] = f"""
SELECT model, prompt,
       (floor(floor((max(CASE WHEN metric = 'prec' THEN value END)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS prec,
       (floor(floor((max(CASE WHEN metric = 'rec' THEN value END)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS rec,
       (floor(floor((max(CASE WHEN metric = 'f1' THEN value END)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS f1,
       (floor(floor((max(CASE WHEN metric = 'rprec' THEN value END)) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS rprec
FROM ({ss}) GROUP BY model, prompt
"""
    vgrid = _grid_sql(VOTE_PRED, "ensemble")
    q["q_candidates_auc"] = f"""
SELECT ensemble, (floor(floor((pr_auc) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS pr_auc FROM ({_auc_sql(vgrid, 'ensemble')})
ORDER BY (floor(floor((pr_auc) * 1e9 + 0.5) / 1e9 * 1000000000.0 + 0.5) / 1000000000.0) DESC, ensemble LIMIT 10
"""
    q["q_subtract_member"] = f"""
WITH p AS ({PRED_SQL}),
m AS (SELECT * FROM ({MEMBERS_SQL}) WHERE ensemble = 'all'),
n AS (SELECT count(*) AS n FROM m),
f AS (SELECT doc_id, label_id, sum(score) / (SELECT n FROM n) AS x
      FROM p JOIN m USING (model, prompt) GROUP BY doc_id, label_id),
s AS (SELECT doc_id, label_id, max(score) AS y FROM p WHERE model = 'A' AND prompt = 'F' GROUP BY ALL),
r AS (SELECT f.doc_id, f.label_id,
             greatest(0.0, least(1.0, ((SELECT n FROM n) * f.x - coalesce(s.y, 0.0)) / ((SELECT n FROM n) - 1))) AS score
      FROM f LEFT JOIN s USING (doc_id, label_id))
SELECT doc_id, label_id, (floor(floor((score) * 1e9 + 0.5) / 1e9 * 1000000.0 + 0.5) / 1000000.0) AS score FROM r WHERE abs(score) > 1e-10
"""
    q["q_parse_answers"] = f"""
WITH h AS (SELECT model, prompt, doc_id,
                  split_part(split_part(answer, chr(10), 1), '<', 1) AS head FROM ({RESP_SQL})),
parts AS (SELECT model, prompt, doc_id,
                 unnest(string_split(head, ', ')) AS piece FROM h),
c AS (SELECT model, prompt, doc_id,
             regexp_replace(piece, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS candidate FROM parts)
SELECT DISTINCT model, prompt, doc_id, candidate FROM c WHERE length(candidate) > 1
"""
    q["q_content_truncate"] = f"""
WITH d AS (SELECT doc_id, title || ' ' || abstract AS content FROM ({DOCS_SQL})),
w AS (SELECT doc_id, content,
             regexp_split_to_array(regexp_replace(content, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g'),
                                   '[ \\t\\n\\r\\f]+') AS words FROM d)
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words,
       CASE WHEN len(words) <= {4096 - 100 - 320} THEN content ELSE array_to_string(words[1:{4096 - 100 - 320}], ' ') END AS content
FROM w
"""
    q["q_submission"] = f"""
WITH v AS (SELECT doc_id, label_id, score FROM ({VOTE_SQL}) WHERE ensemble = 'all'),
s AS ({STRATA_SQL})
SELECT any_value(s.text_type) AS text_type, any_value(s.language) AS language, v.doc_id,
       list(v.label_id ORDER BY v.score DESC, v.label_id) AS "dcterms:subject"
FROM v JOIN s USING (doc_id) GROUP BY v.doc_id
"""
    for name, k in (("q_knn_top1", 1), ("q_knn_topk", 5)):
        q[name] = f"SELECT query_id, label_id, label_text, {r6('cosine')} AS cosine FROM ({knn_sql(VEC_Q_SQL, VEC_V_SQL, k)})"
    q["q_knn_ivf_all"] = q["q_knn_topk"]  # with every cluster probed the search is exact
    q["q_embed_batch"] = EMBED_SQL
    q["q_greedy_forward"] = greedy_forward_sql()
    q["q_greedy_backward"] = greedy_backward_sql()
    q["q_greedy_recurrent"] = greedy_recurrent_sql()
    q["q_sample_ensembles"] = _best_ensembles_sql(vote_sql(sampled_members_sql(3, 1, 8, 1)))
    q["q_bm25_top1"] = f"SELECT query_id, label_id, {r6('score')} AS score FROM ({bm25_sql(TEXTQ_SQL, TEXTC_SQL, 1)})"
    q["q_hybrid_top1"] = hybrid_sql(0.7)
    q["q_vocab_labels"] = f"""
SELECT regexp_extract(s, '[^/]*$') AS label_id, nfc_normalize(o) AS label_text,
       p = '{PREF_LABEL}' AS is_prefLabel
FROM ({TRIPLES_SQL}) WHERE p IN ('{PREF_LABEL}', '{ALT_LABEL}')
"""
    q["q_records"] = """
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id,
       CASE WHEN d.doc_id % 2 = 0 THEN t.title ELSE t.title || ' (cont.)' END AS title,
       t.abstract AS abstract,
       ['gnd:q' || coalesce(CAST(l.quality AS VARCHAR), 'na'), 'gnd:t' || coalesce(CAST(l.toxic AS VARCHAR), 'na')]
           AS "dcterms:subject",
       ['quality ' || d.source, 'toxic ' || d.lang] AS labels
FROM documents d LEFT JOIN labels l USING (doc_id)
JOIN (SELECT doc_id,
             CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, 1, strpos(text, chr(10)) - 1) ELSE text END AS title,
             CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS abstract
      FROM documents) t USING (doc_id)
"""
    q["q_dedupe_docs"] = f"""
WITH d AS ({DOCS_SQL}),
two AS (SELECT *, 'dev' AS split FROM d WHERE language = 'de' UNION ALL SELECT *, 'train' AS split FROM d),
dd AS (SELECT * FROM two QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY split) = 1)
SELECT doc_id, split, language, text_type FROM dd
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  AND doc_id IN (SELECT doc_id FROM labels)
"""
    q["q_sample_sizes"] = f"""
WITH d AS ({DOCS_SQL}),
c AS (SELECT language, text_type, count(*) AS cnt FROM d GROUP BY ALL),
s AS (SELECT language, text_type,
             CASE WHEN 300 > (SELECT count(*) FROM d) THEN cnt
                  ELSE CAST(round_even(300.0 / (SELECT count(*) FROM d) * cnt, 0) AS BIGINT) END AS n_sampled
      FROM c)
SELECT language, text_type, CAST(n_sampled AS BIGINT) AS n_sampled FROM s WHERE n_sampled > 0
"""
    ex = CHATML_SQL
    q["q_render_prompts"] = f"""
SELECT prompt,
       {ex['head']} || string_agg(replace({ex['example']}, '{{text}}', text)
                                || replace({ex['keywords']}, '{{keywords}}', keywords), '' ORDER BY ord)
       || {ex['test_item']} AS frame
FROM ({EXAMPLES_SQL}) GROUP BY prompt
"""
    one_run = f"SELECT * FROM ({PRED_SQL}) WHERE model = 'A' AND prompt = 'F'"
    q["q_unpredicted_docs"] = f"""
SELECT e.ensemble, g.doc_id FROM (SELECT DISTINCT ensemble FROM ({MEMBERS_SQL})) e CROSS JOIN (SELECT DISTINCT doc_id FROM ({GOLD_SQL})) g
WHERE (e.ensemble, g.doc_id) NOT IN (SELECT m.ensemble, p.doc_id FROM ({PRED_SQL}) p JOIN ({MEMBERS_SQL}) m
    ON p.model IS NOT DISTINCT FROM m.model AND p.prompt IS NOT DISTINCT FROM m.prompt)
"""
    q["q_match_docs"] = f"""
WITH g AS (SELECT * FROM ({GOLD_SQL}) WHERE doc_id IN (SELECT doc_id FROM ({one_run}))),
p AS (SELECT * FROM ({one_run}) WHERE doc_id IN (SELECT doc_id FROM g))
SELECT doc_id, n_gold_rows, n_pred_rows FROM (SELECT doc_id, count(*) AS n_gold_rows FROM g GROUP BY doc_id)
FULL JOIN (SELECT doc_id, count(*) AS n_pred_rows FROM p GROUP BY doc_id) USING (doc_id)
"""
    lines = """
SELECT 'conv' || CAST(conv_id AS VARCHAR) AS prompt, turn AS line_no,
       CASE WHEN role = 'user' THEN 'Text: ' || replace(text, chr(10), ' ')
            WHEN role = 'assistant' THEN 'Schlagwörter: ' || replace(text, chr(10), ' ')
            ELSE 'IDN: ' || replace(text, chr(10), ' ') END AS line
FROM conversations
"""
    strip = "regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    q["q_prompt_lines"] = f"""
WITH l AS ({lines}),
k AS (SELECT *, starts_with(line, 'Schlagwörter: ') AS kw FROM l),
s AS (SELECT *, coalesce(sum(CAST(kw AS INTEGER)) OVER (PARTITION BY prompt ORDER BY line_no
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM k),
t AS (SELECT *, last_value(CASE WHEN starts_with(line, 'Text: ') THEN {strip.format(x="substr(line, 7)")} END IGNORE NULLS)
                  OVER (PARTITION BY prompt, seg ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS txt
      FROM s)
SELECT prompt, CAST(seg + 1 AS INTEGER) AS ord, coalesce(txt, '') AS text,
       {strip.format(x="substr(line, 15)")} AS keywords
FROM t WHERE kw
"""
    q["q_translate_ids"] = f"""
SELECT p.model, p.prompt, p.doc_id, p.label_id AS internal_id, 'gnd:' || t.p_brand AS label_id
FROM (SELECT model, prompt, doc_id, regexp_replace(label_id, '^gnd:', '') AS label_id FROM ({PRED_SQL})) p
JOIN (SELECT CAST(p_partkey AS VARCHAR) AS idn, p_brand FROM part WHERE p_size <= 45) t ON p.label_id = t.idn
"""
    q["q_rank_stage"] = f"""
WITH e AS (SELECT doc_id, label_id, term FROM ({VOTE_SQL}) WHERE ensemble = 'all'
           AND doc_id IN (SELECT doc_id FROM ({DOCS_SQL}) WHERE title IS NOT NULL)),
t AS (SELECT DISTINCT doc_id, term FROM e),
a AS (SELECT doc_id, term, CAST(length(term) % 11 AS DOUBLE) AS relevance FROM t),
acc AS (SELECT * FROM a WHERE relevance >= 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY term) <= 50),
lab AS (SELECT doc_id, term, max(label_id) AS label_id FROM e GROUP BY doc_id, term),
j AS (SELECT acc.doc_id, lab.label_id, acc.relevance FROM acc JOIN lab USING (doc_id, term))
SELECT doc_id, label_id, {r6("max(coalesce(relevance / nullif((SELECT max(relevance) FROM j), 0), 0.0))")} AS score
FROM j GROUP BY doc_id, label_id
"""
    q["q_complete_stage"] = f"""
WITH c AS (SELECT doc_id, title || ' ' || abstract AS content FROM ({DOCS_SQL})),
w AS (SELECT doc_id, unnest(regexp_split_to_array(replace(replace(content, ',', ' '), '.', ' '), '[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]+')) AS word,
             generate_subscripts(regexp_split_to_array(replace(replace(content, ',', ' '), '.', ' '), '[\\s\\p{{Z}}\\x0B\\x1C-\\x1F\\x85]+'), 1) AS place
      FROM c WHERE content IS NOT NULL),
f AS (SELECT doc_id, word, min(place) AS place FROM w WHERE length(word) > 3 GROUP BY ALL),
five AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY place) <= 5),
a AS (SELECT doc_id, split_part(string_agg(word, ', ' ORDER BY place), '<', 1) AS head FROM five GROUP BY doc_id),
k AS (SELECT DISTINCT doc_id, regexp_replace(unnest(string_split(head, ', ')), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS candidate FROM a),
p AS (SELECT prompt FROM ({EXAMPLES_SQL}) GROUP BY prompt ORDER BY count(*) DESC, prompt LIMIT 3)
SELECT m.model, p.prompt, k.doc_id, k.candidate FROM k CROSS JOIN p CROSS JOIN (VALUES ('m1'), ('m2')) m(model) WHERE length(k.candidate) > 1
"""
    q["q_scan_csv"] = "SELECT doc_id, lang, length(coalesce(text, ''))::INT AS n, sha256(coalesce(text, '')) AS sha256 FROM documents"
    q["q_scan_turtle"] = q["q_vocab_labels"]
    q["q_append_runs"] = f"SELECT model, prompt, doc_id, label_id, {r6('score')} AS score FROM ({PRED_SQL})"
    unit = lambda text: f"""list_transform(range(0, {len(LETTERS)}), lambda d: CAST((length({text}) - length(replace({text}, substr('{LETTERS}', d + 1, 1), '')))
         / greatest(sqrt(CAST(list_sum(list_transform(range(0, {len(LETTERS)}), lambda e: pow(length({text}) - length(replace({text}, substr('{LETTERS}', e + 1, 1), '')), 2))) AS DOUBLE)), 1e-12) AS FLOAT)::DOUBLE)"""  # noqa: E731
    q["q_map_pipeline"] = f"""
WITH k AS ({q["q_parse_answers"]}),
c AS MATERIALIZED (SELECT candidate, {unit("candidate")} AS e FROM (SELECT DISTINCT candidate FROM k)),
v AS MATERIALIZED (SELECT label_id, label_text, {unit("label_text")} AS e FROM ({q["q_vocab_labels"]})),
near AS (SELECT candidate, label_id, label_text AS term, round(CASE WHEN list_sum(c.e) = 0 OR list_sum(v.e) = 0 THEN 0.0 ELSE list_cosine_similarity(c.e, v.e) END, 12) AS cosine
         FROM c CROSS JOIN v QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY cosine DESC, label_id, label_text) = 1),
kept AS (SELECT k.model, k.prompt, k.doc_id, 'gnd:' || near.label_id AS label_id, k.candidate, near.term, near.cosine FROM k JOIN near USING (candidate) WHERE cosine >= 0.3),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY model, prompt, doc_id, label_id ORDER BY cosine DESC, candidate DESC) = 1)
SELECT model, prompt, doc_id, label_id, candidate, term, {r6('cosine')} AS cosine_similarity, CAST(NULL AS DOUBLE) AS hybrid_score, {r6('cosine')} AS score FROM best
"""
    return q
