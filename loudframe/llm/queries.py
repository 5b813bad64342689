"""One query per corpus operator over whole tables, with SQL statements where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loudframe.llm import chat, decontamination, divergence, embeddings, lm, merkle, packing, pieces, quality, sharding, simhash, toxicity, warc
from loudframe.llm.common import remainder_of_id, table
from loudframe.session import fresh_path

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return put


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_assignment(table(spark, sf_dir, "documents"), n_shards=8)


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(rf"""
WITH items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS t
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL} AS w FROM documents),
cut AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
        FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT r, i, windows.k, item_id FROM cut JOIN windows ON cut.t = windows.t AND cut.k = windows.k),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words_hit USING (r) LEFT JOIN found USING (r)
""")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _labelled(spark: SparkSession, sf_dir: str, modulus: int, held_out: int) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.where(remainder_of_id(labels["doc_id"], modulus) != held_out)


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _labelled(spark, sf_dir, 5, 0))
    return toxicity.score(docs, model).select(
        "doc_id", (remainder_of_id(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "spans")


@query("""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM q
""")
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write_archives(warc.record_plan(table(spark, sf_dir, "pages")), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _labelled(spark, sf_dir, 3, 1))
    return quality.score(docs, model).select(
        "doc_id", (remainder_of_id(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


TRICKY = r"\### Assistant: </turn> ok"


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS n,
             lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS escaped,
             CASE WHEN role IN ('system', 'user', 'assistant') THEN role
                  ELSE '?' || regexp_replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'), '([:\n])', '\\\1', 'g') END AS mark,
             CASE WHEN (before = '' AND n = 0 AND role IN ('system', 'user')) OR (before = 'system' AND role = 'user')
                    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') THEN 1 ELSE 0 END AS fits FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '')) AS loss_sha256,
       CAST(sum(4 + length(mark) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
       min(fits) = 1 AND arg_max(role, n) = 'assistant' AS valid
FROM e GROUP BY conv_id
""")
def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    segments = chat.format_segments(chat.ordered(given.unionByName(more)))
    return chat.read_back(segments).drop("error")


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@query()
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query()
def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = docs.where(remainder_of_id(docs["doc_id"], 7) != 2)
    counts = lm.token_counts(train)
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()[0]
    scored = lm.score(docs, counts, lm.fit(train, counts))
    return scored.select("doc_id", (remainder_of_id(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known",
                         F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


TERMS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"


@query(rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS_SQL} AS w FROM documents),
t AS (SELECT r, lang, source, translate(unnest(w), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
s AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY lang, source),
l AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n, sum(CAST(sum(n) AS BIGINT)) OVER (PARTITION BY lang) AS total FROM c GROUP BY lang, term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 5)) // (coalesce(total, 0) + 5 * v) AS p
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN s ON s.lang = g.lang AND s.source = g.source),
q AS (SELECT lang, term, 1 + (1000000000 * (CAST(n AS HUGEINT) + 5)) // (total + 5 * v) AS q FROM l JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
WHERE part = 'pair' OR rank <= 50
""")
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(table(spark, sf_dir, "documents"))


def piece_path() -> str:
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


@query()
def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pieces.encode(docs, piece_path(), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def _leaf_sql(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


#: crc32 of a whole number written as text: each byte enters at the first of its eight shifts.
_CRC_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(CAST({0} AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(CAST({0} AS VARCHAR)[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384)))"""


def _tree_sql(name: str, start: str) -> str:
    """All levels of trees: (tree, level, nodes), and the last one."""
    return f"""{name}(tree, level, nodes) AS (
  {start} UNION ALL
  SELECT tree, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))
  FROM {name} WHERE len(nodes) > 1)"""


@query(f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf, {_leaf_sql('n_chars + 1')} AS other FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree FROM d),
{_tree_sql("low", "SELECT tree, 0, list(leaf ORDER BY idx) FROM t GROUP BY tree")},
sub AS (SELECT tree, nodes[1] AS subroot FROM low WHERE len(nodes) = 1),
{_tree_sql("high", "SELECT 0, 0, list(subroot ORDER BY tree) FROM sub")},
steps AS (SELECT doc_id, idx, t.tree, level, (idx >> level) AS i, nodes FROM t JOIN low ON t.tree = low.tree WHERE len(nodes) > 1
          UNION ALL SELECT doc_id, idx, t.tree, 1000 + level, ((t.tree - 1) >> level) AS i, nodes FROM t, high WHERE len(nodes) > 1),
sides AS (SELECT tree, idx, level, coalesce(nodes[xor(i, 1) + 1], '') AS sibling, CASE WHEN i % 2 = 1 THEN 'L' ELSE 'R' END AS side FROM steps),
proof AS (SELECT tree, idx, string_agg(sibling, '' ORDER BY level) AS siblings, list(side || sibling ORDER BY level) AS way FROM sides GROUP BY tree, idx),
seen AS (SELECT t.*, subroot, sha256(coalesce(siblings, '')) AS proof_sha256, (SELECT nodes[1] FROM high WHERE len(nodes) = 1) AS root, {_CRC_SQL.format('doc_id')} % 7 = 0 AS bad, coalesce(way, []) AS way
         FROM t JOIN sub USING (tree) LEFT JOIN proof USING (tree, idx)),
folded AS (SELECT *, list_reduce(list_prepend(CASE WHEN bad THEN coalesce(other, leaf) ELSE leaf END, way),
                  lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM seen)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
""")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.document_manifest(docs, tampered)
    folded = merkle.folded(F.col("seen_leaf"), F.col("proof"))
    return (found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
