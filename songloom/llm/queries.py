"""The operators as queries over the given tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.llm import chat, exact, mixing, near, negatives, packing, pages, quality, repair, rules, simhash, suffix, toxicity

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WEIGHTS = (5, 2, 1)


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[run.__name__] = in_utc
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[toxicity.Model, DataFrame]:
    """Learned from the labels that are not held out, with the term counts of ``docs``."""
    labels = table(spark, sf_dir, "labels").where(~quality.in_fold(5, 0))
    return toxicity.learn(docs, labels.select("doc_id", F.col("toxic").alias("label")))


@query()
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents")), WEIGHTS)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


@query(r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ),
    s AS (
        SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM w
    ),
    e AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
    links AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b USING (shingle) WHERE a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ),
    reached AS (
        SELECT doc_id, doc_id AS other FROM s
        UNION SELECT links.a, reached.other FROM reached JOIN links ON links.b = reached.doc_id
    ),
    c AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
""")
def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).drop("hash", "component")


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
""")
def op6_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query(r"""
    WITH d AS (
        SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents
    ),
    w AS (
        SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
        FROM d
    ),
    places AS (
        SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)
    ),
    repeated AS (
        SELECT r, count(DISTINCT p) AS n FROM (
            SELECT r, unnest([i, i + 1, i + 2]) AS p FROM places WHERE n > 1
        ) GROUP BY r
    ),
    m AS (
        SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars,
            len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(l) - len(list_distinct(l)) AS n_dup_lines,
            coalesce(repeated.n, 0) AS n_repeat_words, len(l) AS n_lines,
            len(t) - len(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
            len(t) - len(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters,
            len(t) - len(replace(t, '!', '')) AS n_exclamation
        FROM w LEFT JOIN repeated USING (r)
    ),
    f AS (
        SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
            + 4 * (100 * n_symbols > 20 * n_words)::BIGINT
            + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
            + 16 * (100 * word_chars < 250 * n_words)::BIGINT
            + 32 * (100 * word_chars > 1200 * n_words)::BIGINT
            + 64 * (100 * n_upper > 50 * n_letters)::BIGINT
            + 128 * (100 * n_exclamation > 30 * n_words)::BIGINT AS failed
        FROM m
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed
    FROM f
""")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.kept_under(rules.BASE)).alias("base_failed"),
        rules.kept_under(rules.POLICIES[rules.CURRENT]).alias("kept"), "failed",
    )


def _ablation_sql() -> str:
    """What each rule of each policy does, from the rows of op7."""
    rows = ", ".join(
        f"('{policy}', '{rule}', {rules.mask(members)}, {rules.mask([rule])})" for policy, members in rules.POLICIES.items() for rule in members
    )
    return f"""
        WITH l AS ({ORACLES["op7_quality_rules"]}), p(policy, rule, members, bit) AS (VALUES {rows})
        SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS failing,
            count(*) FILTER (failed & members = bit) AS "only"
        FROM l, p GROUP BY policy, rule
    """


@query(_ablation_sql())
def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


@query()
def op9_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@query()
def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


@query()
def op3_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.in_fold(4, 2))
    forest = quality.learn(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.quality_scores(docs, forest).select(
        "doc_id", quality.in_fold(4, 2).alias("held_out"), "score", "predicted"
    )


@query()
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counted = toxicity_model(spark, docs, sf_dir)
    return toxicity.judged(counted, model).select(
        "doc_id", quality.in_fold(5, 0).alias("held_out"), "score", "predicted", "evidence"
    )


@query()
def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_texts(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


@query(r"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ),
    m AS (
        -- A backslash for every control string, and the marks round each turn.
        SELECT *, 8 + len(role) + len(text)
            + len(regexp_extract_all(role || chr(10) || text, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)'))
            + len(regexp_extract_all(role || chr(10) || text, '\[\\*(?:INST\]|/INST\])')) AS formatted
        FROM t
    )
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
        sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS LAST, role, text)) AS loss_sha256,
        sum(formatted)::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id
""")
def op2_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = [(-1, 0, "user", marks), (-1, 1, chat.LEARNED, marks)]
    added = spark.createDataFrame(extra, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_chats(turns.unionByName(added)))


@query()
def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("""
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
            list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    s AS (
        SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
            list_inner_product(a.e, b.e)::BIGINT AS score
        FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ),
    p AS (
        SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
    ),
    n AS (
        SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
            row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    )
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
    FROM n WHERE rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.prepared(vectors, label=wrong))


@query()
def op12_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(turns), turns)
