"""The queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fill_middle, fingerprints, lm_scores, mixing, near_dedup, packing, secrets_scan, simhash, spelling, substring_dedup, token_counts, toxicity
from .common import table


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))["documents"]


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target is what `labels` marks as of good quality; the background is all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scores.score(table(spark, sf_dir, "documents"), good)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), *digests)


_ALL = (op1_secret_scan, op2_fingerprints, op3_source_mix, op4_exact_dedup, op5_token_counts, op6_toxicity, op7_substring_dedup, op8_near_dedup, op9_lm_scores, op10_packing, op11_spelling_variants, op12_simhash, op13_fill_middle)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
_SCRAMBLE = "(({}) % 2147483647 * 48271 % 2147483647) * 16807 % 2147483647"
_Y = f"({_SCRAMBLE.format('src % 2147483647 * 15485863 + slot % 2147483647 * 32452843 + 1')})"
_DRAWN = _SCRAMBLE.format(f"({_Y} * {_Y} % 2147483647 + 1)")
_KEY = "(src * 7919 + slot // blocks * 104729)"
_OTHER = f"((({_SCRAMBLE.format(_KEY + ' + r * 1299709')}) % blocks - x) % blocks + blocks) % blocks"
_STEP = f"CASE WHEN ({_SCRAMBLE.format(f'greatest(x, {_OTHER}) + {_KEY} * 31 + r * 7919')}) % 1024 < 512 THEN {_OTHER} ELSE x END"

ORACLE_SQL: dict[str, str] = {
    "op3_source_mix": f"""
        WITH sized AS (SELECT row_number() OVER () AS row_no, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        total AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM sized GROUP BY 1),
        w AS (SELECT *, 1.0::DOUBLE + src % 3 AS weight, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / (1 + src % 3) AS full_at FROM total),
        l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER u - cap)) / (sum(weight) OVER () - (sum(weight) OVER u - weight)) AS level_here FROM w WINDOW u AS (ORDER BY full_at, src)),
        s AS (SELECT source, src, source_size, least(cap, (SELECT arg_min(level_here, (full_at, src)) FROM l WHERE level_here <= full_at) * weight) AS target, greatest(1, least({mixing.BLOCK}, ceil(source_size / {mixing.FINEST}.0)))::BIGINT AS grain FROM l),
        m AS (SELECT *, ceil(source_size / grain)::BIGINT AS blocks FROM s),
        n AS (SELECT *, coalesce(round(target * blocks / nullif(source_size, 0)), 0)::BIGINT AS slots FROM m),
        placed AS (SELECT z.row_no, z.doc_id, z.size, n.src, n.source_size, n.target, n.grain, sum(z.size) OVER (PARTITION BY n.src ORDER BY z.doc_id NULLS FIRST, z.size, z.row_no) - z.size AS start
            FROM sized z JOIN n ON z.source IS NOT DISTINCT FROM n.source),
        slot AS (SELECT src, blocks, unnest(range(slots)) AS slot, greatest(1, ceil(sum(slots) OVER () / {mixing.SHARD_SLOTS}.0))::BIGINT AS shards FROM n),
        used AS (SELECT src, block, count(*) AS times, min(shard) AS first_shard FROM (
            SELECT src, ({_DRAWN}) % shards AS shard, list_reduce(list_prepend(slot % blocks, range({mixing.ROUNDS})), lambda x, r: {_STEP}) AS block FROM slot) GROUP BY 1, 2),
        piece AS (SELECT *, unnest(range((start // grain)::BIGINT, ((start + size - 1) // grain)::BIGINT + 1)) AS block FROM placed WHERE size > 0),
        taken AS (SELECT row_no, sum((least(start + size, (block + 1) * grain) - greatest(start, block * grain)) * coalesce(times, 0)) AS taken, min(first_shard) AS first_shard
            FROM piece LEFT JOIN used USING (src, block) GROUP BY 1)
        SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_shard FROM placed LEFT JOIN taken USING (row_no)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))""",
    "op7_substring_dedup": """
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS first FROM win) WHERE first < doc_id),
        gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM hit) GROUP BY 1),
        kept AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, w, ps FROM d LEFT JOIN gone USING (doc_id))
        SELECT doc_id, n_words, n_removed, sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE
            array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(ps, p)), lambda p: w[p]), ' ') END) AS kept_sha256 FROM kept""",
    "op8_near_dedup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        sh AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
        link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
            WHERE 100 * c >= 75 * (p.n + q.n - c)),
        e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        r AS (SELECT doc_id AS s, doc_id AS t FROM d UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.t)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.t) AS component_id, d.doc_id = min(r.t) AS kept FROM d JOIN r ON r.s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op13_fill_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
        h AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS c1, greatest(h1 % (n + 1), h2 % (n + 1)) AS c2,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substring(t, 1, c1) AS a, substring(t, c1 + 1, c2 - c1) AS b, substring(t, c2 + 1) AS z FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN c1 END AS prefix_chars, CASE WHEN form <> 'plain' THEN c2 - c1 END AS middle_chars, sha256(t) AS restored_sha256,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256 FROM p""",
}
