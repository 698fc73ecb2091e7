"""One query per operator, each over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptline.llm import automata, bpe, fingerprints, langid, lm, near, packing, pii, quality, sharding, suffixes, trie, whitening

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def digest(column: str) -> F.Column:
    return F.sha2(F.col(column), 256)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, _ = packing.pack(packing.pieces(documents(spark, sf_dir), VOCABULARY, capacity=1024, end_id=2))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "coverage")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(documents(spark, sf_dir))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 5).alias("mean_log_score"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", digest("kept").alias("kept_sha256"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest("base").alias("base_sha256"), "spans")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.remove_repeats(documents(spark, sf_dir))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", digest("kept").alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean(documents(spark, sf_dir))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return cleaned.select(*base, "n_lost", "n_lines_lost", digest("clean").alias("clean_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), VOCABULARY)
    both = bpe.decode(encoded.withColumn("ids_sha256", digest("ids")), VOCABULARY, keep=("n_tokens", "ids_sha256"))
    return both.select("doc_id", "n_tokens", "ids_sha256", digest("text").alias("decoded_sha256"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(documents(spark, sf_dir))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, keys, sizes): the first h turns of conversation c - c % 5, then c's own from its turn h on."""
    own = trie.paths(conversations).withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    head = own.select(F.col("conv_id").alias("base"), F.slice("keys", 1, 8).alias("head_keys"), F.slice("sizes", 1, 8).alias("head_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")

    def joined(head: str, column: str) -> F.Column:
        before = F.when(F.col(head).isNull(), F.slice(column, 1, 0)).otherwise(F.slice(head, F.lit(1), h))
        return F.concat(before, F.slice(F.col(column), h + 1, F.greatest(F.size(column), F.lit(1)))).alias(column)

    return own.join(head, "base", "left").select("conv_id", joined("head_keys", "keys"), joined("head_sizes", "sizes"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.nodes(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    model = whitening.fit_quantised(rows, k=8)
    white = whitening.whiten(rows, model, "vec_id").withColumn("deviation", F.col("deviation").cast("long"))
    return white.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(model.identity_error).alias("identity_error"))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), sharding.cluster(regions=4, racks=2, shards=2))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_WORDS = """words AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents))"""

#: The table of CRC-32 for one byte.
_CRC32 = """crc_table AS MATERIALIZED (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b))"""


def _crc32(value: str) -> str:
    """Unsigned CRC-32 of a string's bytes in UTF-8; ``t`` is the table."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({value})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce({numbers}, lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295), 4294967295)"


def _descent(regions: int, racks: int, shards: int) -> str:
    """CTEs ``edges`` and ``level0`` to ``level3``: the rows of ``sized`` go down two trees, the second with one more shard."""
    tree = sharding.cluster(regions, racks, shards)
    levels = [(g, level) for g, t in enumerate((tree, sharding.with_shard(tree))) for level in sharding.levels(t)]
    edges = ", ".join(f"({g}, '{above}', '{c.name}', {float(c.weight)}::DOUBLE)" for g, level in levels for above, children in level.items() for c in children)
    hashed = "('0x' || substr(md5(concat_ws('|', doc_id::VARCHAR, e.name)), 1, 13))::BIGINT::DOUBLE"
    down = [
        f"level{i + 1} AS (SELECT r, doc_id, l.grown, arg_min(e.name, -ln(({hashed} + 0.5::DOUBLE) / 4503599627370496) / e.weight) AS place "
        f"FROM level{i} l JOIN edges e ON e.grown = l.grown AND e.above = l.place GROUP BY r, doc_id, l.grown)"
        for i in range(3)
    ]
    return f"edges(grown, above, name, weight) AS (VALUES {edges}),\n    level0 AS (SELECT r, doc_id, grown, 'all' AS place FROM sized, (VALUES (0), (1)) g(grown)),\n    " + ",\n    ".join(down)


ORACLE = {
    "op4_lm_scores": f"""WITH {_WORDS},
    seq AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM words),
    one AS (SELECT word, count(*) AS n FROM words GROUP BY word),
    two AS (SELECT before, word, count(*) AS n FROM seq WHERE before IS NOT NULL GROUP BY ALL),
    scored AS (
        SELECT s.doc_id, CASE WHEN two.n >= 2 THEN ln(two.n / context.n)
            ELSE ln(one.n / (SELECT count(*) FROM words)) + CASE WHEN s.before IS NULL THEN 0 ELSE ln(0.4) END END AS value
        FROM seq s JOIN one ON one.word = s.word LEFT JOIN one AS context ON context.word = s.before
        LEFT JOIN two ON two.before = s.before AND two.word = s.word)
    SELECT d.doc_id, count(value) AS n_words, round(coalesce(sum(value), 0), 3) AS log_score, round(avg(value), 5) AS mean_log_score
    FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op5_substring_dedup": f"""WITH {_WORDS},
    lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    starts AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM lists WHERE len(w) >= 50),
    wins AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM starts),
    firsts AS (SELECT h, min(doc_id) AS first_id FROM wins GROUP BY h),
    hits AS (SELECT doc_id, i FROM wins JOIN firsts USING (h) WHERE first_id < doc_id),
    seen AS (
        SELECT w.doc_id, w.i, w.word, max(h.i) OVER (PARTITION BY w.doc_id ORDER BY w.i) AS last_hit
        FROM words w LEFT JOIN hits h ON h.doc_id = w.doc_id AND h.i = w.i)
    SELECT d.doc_id, count(s.i) AS n_words, count(CASE WHEN s.i - s.last_hit < 50 THEN 1 END) AS n_removed,
        sha256(coalesce(string_agg(CASE WHEN s.last_hit IS NULL OR s.i - s.last_hit >= 50 THEN s.word END, ' ' ORDER BY s.i), '')) AS kept_sha256
    FROM documents d LEFT JOIN seen s ON s.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op10_near_duplicates": f"""WITH RECURSIVE {_WORDS},
    lens AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS w FROM words GROUP BY doc_id),
    five AS (
        SELECT doc_id, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s || ' ' || lead(word, 3) OVER s || ' ' || lead(word, 4) OVER s AS g
        FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
    grams AS (SELECT DISTINCT doc_id, g FROM five WHERE g IS NOT NULL UNION SELECT doc_id, w FROM lens WHERE n < 5),
    sizes AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    linked AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE n >= 0.8 * (x.size + y.size - n)),
    edges AS (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
    reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
    classes AS (SELECT d.doc_id, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS class_id FROM documents d LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id)
    SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows FROM classes""",
    "op11_conversation_trie": f"""WITH {_CRC32},
    own AS (
        SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    cut AS (SELECT own.*, {_crc32('conv_id::VARCHAR')} % 9 AS h FROM own, crc_table),
    built AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns[:c.h], []), c.turns[c.h + 1:]) AS turns
        FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    prefixes AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
    steps AS (SELECT conv_id, depth, md5(turns[:depth]::VARCHAR || depth) AS node, md5(turns[:depth - 1]::VARCHAR || (depth - 1)) AS above,
        octet_length(encode(turns[depth].t)) AS size, depth = len(turns) AS is_end FROM prefixes),
    nodes AS (
        SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(above) AS above, coalesce(any_value(size), 0) AS size,
            sha256(coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM steps GROUP BY node, depth),
    children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
    below AS (SELECT DISTINCT a.node, b.node AS other FROM steps a JOIN steps b ON b.conv_id = a.conv_id AND b.depth >= a.depth),
    sums AS (
        SELECT b.node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((o.n_convs - 1) * o.size)::BIGINT AS saved_tokens
        FROM below b JOIN nodes o ON o.node = b.other LEFT JOIN children k ON k.node = b.other GROUP BY b.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
    FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children k ON k.node = n.node LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above""",
    "op13_sharding": f"""WITH {_CRC32},
    sized AS (
        SELECT row_number() OVER () AS r, doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_crc32("coalesce(text, '')")} AS text_crc32
        FROM documents, crc_table),
    {_descent(4, 2, 2)},
    ended AS (
        SELECT r, max(CASE WHEN grown = 0 THEN place[7:]::INTEGER END) AS shard, max(CASE WHEN grown = 1 THEN place[7:]::INTEGER END) AS grown_shard
        FROM level3 GROUP BY r)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
    FROM sized JOIN ended USING (r)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_language_id,
        op3_fingerprints,
        op4_lm_scores,
        op5_substring_dedup,
        op6_personal_data,
        op7_suffix_array_dedup,
        op8_quality_rules,
        op9_bpe,
        op10_near_duplicates,
        op11_conversation_trie,
        op12_embedding_whitening,
        op13_sharding,
    )
}
