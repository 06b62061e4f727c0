"""The operators' queries over the tables of a folder, and their SQL where SQL can say them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import decontaminate, fim, language, line_dedup, lm_score, merkle, mix, near_dup, pii, token_count, token_file, topk, toxicity
from wavemill.llm.common import crc_mod, scratch_path, table

END_ID = 2


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("mark")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, *toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_file.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_file.read_token_files(spark, path)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), percent=80)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target set: documents labelled of quality 1. Losses are rounded to six places."""
    target = table(spark, sf_dir, "labels").filter("quality = 1")
    out = lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), target)
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"), plain=90, spm=20, seed=1)
    restored = fim.unfilled(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts are those of the base spans; n_added counts the others."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.learn(docs))
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering takes the line feeds out of the texts whose id's crc32 is even."""
    tampered = F.when(crc_mod(F.col("doc_id"), 2) == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.verify(table(spark, sf_dir, "documents"), {"text": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict:
    return {f.__name__: f for f in (op1_token_counts, op2_topk_search, op3_language_id, op4_decontamination, op5_toxicity, op6_minhash_near_dup, op7_token_files, op8_line_dedup, op9_lm_scoring, op10_source_mix, op11_fill_in_middle, op12_personal_data, op13_merkle_manifest)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
      FROM e q, e c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS t
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
gram AS (SELECT rid, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t
         FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, gram.n, i FROM gram JOIN win ON gram.t = win.t AND gram.n = win.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_OP6 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 4), ' ') AS t
      FROM (SELECT rid, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
k AS (SELECT s.* FROM s JOIN d USING (rid) WHERE doc_id IS NOT NULL),
p AS (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM k x JOIN k y ON x.t = y.t AND x.rid <> y.rid GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.rid = a JOIN n nb ON nb.rid = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(rid, c) AS (SELECT rid, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.rid = e.a),
m AS (SELECT rid, min(c) AS component_id FROM r GROUP BY rid)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, coalesce(d.doc_id = component_id, true) AS kept
FROM d JOIN m USING (rid) LEFT JOIN n USING (rid)
"""

_OP8 = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT doc_id, i - 1 AS line_no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[ \t\x0B\f\r]+'), lambda x: x <> ''))) AS w
      FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d WHERE doc_id IS NOT NULL)),
k AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line, doc_id, line_no, w, len(w) AS n FROM l WHERE len(w) > 0),
t AS (SELECT line, n, unnest(w) AS word FROM k),
f AS (SELECT word, count(*) AS held FROM t GROUP BY word),
p AS (SELECT line, n, word FROM (SELECT t.*, row_number() OVER (PARTITION BY line ORDER BY held, word) AS r FROM t JOIN f USING (word)) WHERE r <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT a.line AS a, b.line AS b FROM p a JOIN p b ON a.word = b.word AND a.line < b.line AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
s AS (SELECT DISTINCT y.doc_id, y.line_no FROM c JOIN k x ON x.line = a JOIN k y ON y.line = b
      WHERE (x.doc_id, x.line_no) <> (y.doc_id, y.line_no) AND 180 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n)),
r AS (SELECT doc_id, list(line_no::INTEGER ORDER BY line_no) AS removed FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(removed), 0)::BIGINT AS n_removed, coalesce(removed, []::INTEGER[]) AS removed
FROM d LEFT JOIN r USING (doc_id)
"""

_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w,
                  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS target FROM documents),
t AS (SELECT rid, target, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS id FROM t GROUP BY word),
size AS (SELECT count(*) AS n FROM v),
k AS (SELECT rid, target, i, coalesce(id, (SELECT n FROM size)) AS tok FROM t LEFT JOIN v USING (word)),
g AS (SELECT rid, target, tok, coalesce(lag(tok) OVER (PARTITION BY rid ORDER BY i), (SELECT n + 1 FROM size)) AS prev FROM k),
c AS (SELECT prev, tok, count(*) AS n_a, count(*) FILTER (target) AS n_t FROM g GROUP BY ALL),
u AS (SELECT range AS tok, coalesce(a, 0) + 1 AS u_a, coalesce(t, 0) + 1 AS u_t FROM range(0, (SELECT n + 1 FROM size))
      LEFT JOIN (SELECT tok, sum(n_a) AS a, sum(n_t) AS t FROM c GROUP BY tok) x ON x.tok = range),
us AS (SELECT tok, u_a / sum(u_a) OVER () AS u_a, u_t / sum(u_t) OVER () AS u_t FROM u),
f AS (SELECT prev, sum(n_a) AS f_a, sum(n_t) AS f_t, count(*) AS k_a, count(*) FILTER (n_t > 0) AS k_t FROM c GROUP BY prev),
l AS (SELECT c.prev, c.tok,
        -ln(coalesce({lm_score.DISCOUNT} * k_t / nullif(f_t, 0), 1) * u_t + CASE WHEN n_t > 0 THEN (n_t - {lm_score.DISCOUNT}) / f_t ELSE 0 END) AS l_t,
        -ln({lm_score.DISCOUNT} * k_a / f_a * u_a + (n_a - {lm_score.DISCOUNT}) / f_a) AS l_a
      FROM c JOIN f USING (prev) JOIN us ON us.tok = c.tok)
SELECT d.doc_id, len(w)::BIGINT AS n_tokens, round(ct, 6) AS ce_target, round(ca, 6) AS ce_background, round(ct - ca, 6) AS score
FROM d LEFT JOIN (SELECT rid, avg(l_t) AS ct, avg(l_a) AS ca FROM g JOIN l ON g.prev = l.prev AND g.tok = l.tok GROUP BY rid) x USING (rid)
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w FROM d),
k AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT doc_id, text, n, form, array_to_string(w[1:least(x, y)], '') AS p, array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(w[greatest(x, y) + 1:], '') AS s FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""


def _leaf_sql(text: str) -> str:
    each = [f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(each)})"


def _tree_sql(name: str, leaves: str) -> str:
    """Common tables of a tree over `leaves` (grp, idx, n, h): name_up (lvl, grp, idx, n, h) of all nodes and name_side (lvl, grp, idx, l, r), what the parent hashes before and after a node."""
    return f"""{name}_up AS (SELECT 0 AS lvl, grp, idx, n, h FROM {leaves} UNION ALL
 SELECT lvl + 1, grp, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_up WHERE n > 1 GROUP BY lvl, grp, idx // 3, n),
{name}_side AS (SELECT lvl, grp, idx, coalesce(string_agg(h, '') OVER (PARTITION BY lvl, grp, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
 coalesce(string_agg(h, '') OVER (PARTITION BY lvl, grp, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_up WHERE n > 1)"""


#: crc32 of the id's decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(0, 8), lambda k: ((ord(c) >> k::INTEGER) % 2)::BIGINT)))),
 lambda c, b: xor(c >> 1, CASE WHEN c % 2 <> b THEN 3988292384 ELSE 0 END)))"""

_OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql('text')} AS h, {_leaf_sql("CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS h2 FROM
 (SELECT *, {_CRC} AS crc FROM documents)),
g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) AS grp FROM (SELECT DISTINCT source FROM d)),
leaves AS (SELECT doc_id, h, h2, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
{_tree_sql('a', 'leaves')},
tops AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n, h FROM a_up WHERE n = 1),
{_tree_sql('b', 'tops')},
walk AS (SELECT idx AS doc, grp, 0 AS lvl, idx, h2 AS acc, '' AS proof FROM leaves UNION ALL
 SELECT doc, w.grp, w.lvl + 1, w.idx // 3, sha256(l || acc || r), proof || l || r FROM walk w JOIN a_side s ON s.lvl = w.lvl AND s.grp = w.grp AND s.idx = w.idx),
arrived AS (SELECT grp, doc, acc, proof FROM walk QUALIFY lvl = max(lvl) OVER (PARTITION BY grp, doc)),
climb AS (SELECT doc, grp, 0 AS lvl, grp - 1 AS idx, acc, proof FROM arrived UNION ALL
 SELECT doc, w.grp, w.lvl + 1, w.idx // 3, sha256(l || acc || r), proof || l || r FROM climb w JOIN b_side s ON s.lvl = w.lvl AND s.idx = w.idx),
out AS (SELECT grp, doc, acc, proof FROM climb QUALIFY lvl = max(lvl) OVER (PARTITION BY grp, doc))
SELECT doc_id, x.h AS leaf, t.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = r.h AS verified
FROM leaves x JOIN out ON out.grp = x.grp AND out.doc = x.idx JOIN tops t ON t.idx = x.grp - 1 JOIN b_up r ON r.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk_search": _OP2, "op4_decontamination": _OP4, "op6_minhash_near_dup": _OP6, "op8_line_dedup": _OP8, "op9_lm_scoring": _OP9, "op11_fill_in_middle": _OP11, "op13_merkle_manifest": _OP13}
