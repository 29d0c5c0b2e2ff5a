"""The operators' queries on the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import hashed
from .chat_format import chat_digest, chat_examples
from .common import read
from .decontaminate import decontaminate
from .jaccard_join import jaccard_join
from . import languages, quality_model, toxicity
from .packing import pack
from .prefix_trie import prefix_trie
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .url_filter import url_filter
from .vector_codes import vector_codes

#: The conversation that the contract adds: it holds the template's own control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]

def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"), keep_text=False, passages=50)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["conv_id", "turn", "role", "text"]
    table = read(spark, sf_dir, "conversations").select(*names)
    return chat_digest(chat_examples(table.unionByName(spark.createDataFrame(PROBE, table.schema))))


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), _remainder(5) == 0
    net = quality_model.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return quality_model.quality(docs, net, extra={"held_out": held_out}).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), _remainder(3) == 1
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~held_out)
    return toxicity.toxicity(docs, model, extra={"held_out": held_out}).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents")).withColumn("failed_rules", F.array_join("failed_rules", ","))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list (entry, action, at) for want of a real one: a quarter of all hosts and path prefixes, by hash, added,
    most of them removed again later and half of those added once more."""
    steps = F.filter(F.split(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), "/"), lambda x: x != "")
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]*)", 1))
    paths = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.concat_ws("/", host, F.array_join(F.when(i > 0, F.slice(steps, 1, F.greatest(i, F.lit(1)))), "/")))
    entries = pages.select(F.explode(paths).alias("entry")).distinct().filter((hashed("entry", 1) % 4 == 0) & (F.col("entry") != ""))
    added = F.date_add(F.lit("2023-07-01").cast("date"), (hashed("entry", 2) % 400).cast("int"))
    removed = F.date_add(added, (hashed("entry", 3) % 200 + 30).cast("int"))
    again = F.date_add(removed, (hashed("entry", 4) % 100 + 15).cast("int"))
    change = lambda action, at: F.struct(F.lit(action).alias("action"), at.alias("at"))  # noqa: E731
    third = F.when(hashed("entry", 4) % 2 == 0, change("add", again))
    changes = F.when(hashed("entry", 3) % 5 == 0, F.array(change("add", added))).otherwise(F.array_compact(F.array(change("add", added), change("remove", removed), third)))
    return entries.select("entry", F.inline(changes))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so page n counts as fetched on day n mod 366 of 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int")).alias("fetched"))
    return url_filter(pages, url_list(pages))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read(spark, sf_dir, "embeddings")).table


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.crc32(F.col("conv").cast("string")) % 4
    return prefix_trie(read(spark, sf_dir, "conversations"), every=20, heads=heads, longest=3)


def op13_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = read(spark, sf_dir, "documents"), _remainder(5) == 0
    return languages.predicted(docs, languages.fit(docs, ~held_out), extra={"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score", "languages", "shares")


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS3 = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP2 = r"""
WITH d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM d, range(0, n - 399) AS r(i) WHERE n >= 400),
twice AS (SELECT k FROM p GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p WHERE k IN (FROM twice)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM hit GROUP BY doc_id, g),
flag AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM run),
num AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS m FROM flag),
span AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM num GROUP BY doc_id, m),
edge AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
part AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM edge JOIN d USING (doc_id) GROUP BY 1),
dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 49], ' ')) AS k FROM dw, range(1, len(w) - 48) AS r(i) WHERE len(w) >= 50),
again AS (SELECT k FROM win GROUP BY 1 HAVING count(*) > 1),
words AS (SELECT doc_id, count(DISTINCT j) AS n_passage_words FROM win, range(i, i + 50) AS r(j) WHERE k IN (FROM again) GROUP BY 1)
SELECT d.doc_id, n AS n_bytes, coalesce(n_passage_words, 0) AS n_passage_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN part USING (doc_id) LEFT JOIN words USING (doc_id)
"""

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS3.format('text')} AS w FROM documents),
i AS (SELECT item_id, {_WORDS3.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS k, len(w[s:s + 9]) AS m
        FROM i, range(1, greatest(len(w) - 9, 1) + 1) AS r(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
dw AS (SELECT doc_id, p, m, array_to_string(w[p:p + m - 1], ' ') AS k
       FROM d, sizes, range(1, len(w) - m + 2) AS r(p) WHERE len(w) >= m),
hit AS (SELECT dw.doc_id, dw.p, dw.m, win.item_id FROM dw JOIN win USING (k, m)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n FROM hit, range(p, p + m) AS r(q) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP4 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS sh FROM d, range(1, greatest(len(w) - 3, 1) + 1) AS r(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN least ON d.doc_id = a
"""

_SAFE = r"replace(replace(replace({0}, '\', '\\'), '<', '\l'), '###', '\h')"
OP5 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
t AS (SELECT *, role = 'assistant' AS reply,
             6 + length(replace(replace({_SAFE.format('role')}, chr(10), '\n'), '>', '\g')) + 2 + length({_SAFE.format('text')}) + 8 AS chars FROM c),
u AS (SELECT *, sum(chars) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (reply), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (reply OR from_end = 1) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

_RULES_SQL = ", ".join(
    f"CASE WHEN NOT ({' AND '.join([f'100 * {r.numerator} >= {r.low} * {r.denominator}'] * (r.low is not None) + [f'100 * {r.numerator} <= {r.high} * {r.denominator}'] * (r.high is not None))}) THEN '{r.name}' END"
    for r in RULES
)
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, p, array_to_string(w[p:p + 2], ' ') AS k FROM d, range(1, len(w) - 1) AS r(p) WHERE len(w) >= 3),
twice AS (SELECT doc_id, k FROM win GROUP BY ALL HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT q) AS n FROM win JOIN twice USING (doc_id, k), range(p, p + 3) AS r(q) GROUP BY 1),
m AS (SELECT n.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
      CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines,
      CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
      CAST(len(list_filter(w, lambda x: x IN ({', '.join(f"'{x}'" for x in sorted(set(STOP_WORDS)))}))) AS BIGINT) AS n_stop_words
      FROM n LEFT JOIN rep USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, concat_ws(',', {_RULES_SQL}) AS failed_rules FROM m)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM v
"""

_HASH = "('0x' || substr(md5('{0}:' || entry), 1, 8))::BIGINT"
OP10 = f"""
WITH u AS (SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS h, list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages),
e AS (SELECT DISTINCT entry FROM (SELECT array_to_string(list_concat([h], s[1:i]), '/') AS entry FROM u, range(0, len(s) + 1) AS r(i)) WHERE entry <> '' AND {_HASH.format(1)} % 4 = 0),
a AS (SELECT entry, DATE '2023-07-01' + CAST({_HASH.format(2)} % 400 AS INTEGER) AS added FROM e),
b AS (SELECT *, added + CAST({_HASH.format(3)} % 200 + 30 AS INTEGER) AS removed, {_HASH.format(3)} % 5 > 0 AS goes, {_HASH.format(4)} % 2 = 0 AS returns FROM a),
changes AS (SELECT entry, 'add' AS action, added AS since FROM b UNION ALL SELECT entry, 'remove', removed FROM b WHERE goes
            UNION ALL SELECT entry, 'add', removed + CAST({_HASH.format(4)} % 100 + 15 AS INTEGER) FROM b WHERE goes AND returns),
spans AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY entry ORDER BY since) AS until FROM changes) WHERE action = 'add'),
p AS (SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
      lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1)) AS host,
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (SELECT p.*, s.entry FROM p LEFT JOIN spans s ON fetched >= since AND (until IS NULL OR fetched < until) AND
      CASE WHEN contains(s.entry, '/') THEN host || rtrim(path, '/') = s.entry OR starts_with(host || path, s.entry || '/')
           ELSE host = s.entry OR ends_with(host, '.' || s.entry) END)
SELECT page_id, url, fetched, nullif(host, '') AS host, count(entry) AS n_active,
       max({{'n': length(entry), 'e': entry}}) FILTER (entry IS NOT NULL).e AS matched, count(entry) > 0 AS blocked
FROM m GROUP BY page_id, url, fetched, host
"""


_FAR = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
OP11 = (
    """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, part, q[part * len(q) // 4 + 1:(part + 1) * len(q) // 4] AS x FROM v, range(4) AS r(part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p QUALIFY e < 256)"""
    + "".join(
        f""",
n{i} AS MATERIALIZED (SELECT p.vec_id, p.part, min({{'d': {_FAR}, 'e': b.e}}) AS m FROM p JOIN b{i} AS b USING (part) GROUP BY 1, 2),
s{i} AS (SELECT part, e, list(c ORDER BY j) AS x FROM (SELECT part, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS c
         FROM (SELECT part, m.e AS e, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM p JOIN n{i} USING (vec_id, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(s.x, b.x) AS x FROM b{i} AS b LEFT JOIN s{i} AS s USING (part, e))"""
        for i in range(4)
    )
    + f""",
n4 AS (SELECT p.vec_id, p.label, p.part, min({{'d': {_FAR}, 'e': b.e}}) AS m FROM p JOIN b4 AS b USING (part) GROUP BY 1, 2, 3),
c AS (SELECT vec_id, label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM n4 GROUP BY 1, 2),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, books
"""
)

_BITS = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
_CRC = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda s, b: {_BITS}))"
OP12 = rf"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role[:64], text[:64], key) AS i, key, len(regexp_extract_all(text, '[^ 	-]+')) AS words
           FROM (SELECT *, sha256(length(role) || ':' || role || text) AS key FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL))),
k AS (SELECT c, count(*) AS n, {_CRC} % 4 AS h, c - c % 20 AS base FROM t GROUP BY c),
g AS (SELECT k.c, k.h, k.base, least(k.h, coalesce(b.n, 0)) AS given FROM k LEFT JOIN k AS b ON b.c = k.base),
r AS (SELECT c, i - h + given AS i, key, words FROM t JOIN g USING (c) WHERE i > h UNION ALL SELECT g.c, i, key, words FROM g JOIN t ON t.c = g.base AND i <= given),
m AS (SELECT c, i AS d, string_agg(key, '') OVER (PARTITION BY c ORDER BY i) AS p, words FROM r UNION ALL SELECT c, 0, '', 0 FROM k),
n AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words FROM m GROUP BY 1, 2),
kids AS (SELECT left(p, 64 * (d - 1)) AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, n_children FROM n LEFT JOIN kids USING (p)),
sub AS (SELECT left(p, 64 * a) AS p, count(*) FILTER (n_children IS NULL) AS n_leaves, sum((n_convs - 1) * words) AS saved FROM w, range(0, d + 1) AS x(a) GROUP BY 1),
ends AS (SELECT p, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(p, d) AS p FROM m GROUP BY c) GROUP BY p)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, w.n_convs, CAST(coalesce(w.n_children, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN sub USING (p) LEFT JOIN ends USING (p) LEFT JOIN n AS up ON w.d > 0 AND up.p = left(w.p, 64 * (w.d - 1))
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2, "op3_decontaminate": OP3, "op4_jaccard_join": OP4, "op5_chat_format": OP5, "op9_quality_rules": OP9, "op10_url_filter": OP10, "op11_vector_codes": OP11, "op12_prefix_trie": OP12}
