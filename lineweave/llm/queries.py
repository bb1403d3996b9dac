"""Queries over the training-data tables: opN_<name> -> function of (spark, sf_dir); SQL where it can say the same."""

from __future__ import annotations

import re
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm.chat_format import format_conversations
from lineweave.llm.common import read
from lineweave.llm.jaccard_join import join_groups
from lineweave.llm.license_scan import SHINGLE, TEMPLATES, scan
from lineweave.llm.line_dedup import drop_boilerplate
from lineweave.llm.packing import pack_documents
from lineweave.llm.quality_rules import judge
from lineweave.llm.sentencepiece_lattice import encode_documents
from lineweave.llm.spot_signatures import fingerprints_and_edits
from lineweave.llm.suffix_dedup import remove_repeats
from lineweave.llm.token_counts import count_tokens


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return format_conversations(own.unionByName(extra))


def op2_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(read(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cleaned = drop_boilerplate(own, "source")
    return cleaned.select("doc_id", "source", "n_lines", "n_dropped", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"), short_anywhere=True)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("spans")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_groups(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: What op1 must say, from the rows alone.
_OP1 = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(25 + length(role) + length(text) + len(regexp_extract_all(text, '<[|]im_start[|]>|<[|]im_end[|]>|<[|]endoftext[|]>|<[|]startoftext[|]>|</?s>|\[/?INST\]|<</?SYS>>')))::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
    'messages' AS layout, sha256('$.messages|$.messages[0].content|$.messages[0].role') AS fingerprint
FROM g
"""
#: Line shares by exact comparison of the lines' texts.
_OP4 = r"""
WITH l AS (
    SELECT doc_id, source, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
total AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
bad AS (
    SELECT l.source, trim(line) AS line FROM l JOIN total ON l.source IS NOT DISTINCT FROM total.source WHERE trim(line) <> ''
    GROUP BY l.source, trim(line) HAVING count(DISTINCT doc_id) >= 10 AND count(DISTINCT doc_id) > 0.05 * any_value(pages)),
m AS (SELECT l.*, bad.line IS NOT NULL AS dropped FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND trim(l.line) = bad.line),
k AS (SELECT doc_id, source, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '') AS kept FROM m GROUP BY doc_id, source)
SELECT doc_id, source, n_lines, n_dropped, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256 FROM k
"""


def _op7() -> str:
    """Containment by exact comparison of the 5-grams' words; a template of fewer words is one gram of its own length."""
    given = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    sizes = {len([w for w in re.split(r"[\W_]+", t) if w]) for t in TEMPLATES.values()}
    words = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    grams = lambda n: f"list_transform(range(1, len(ws) - {n - 2}), lambda i: array_to_string(ws[i:i + {n - 1}], ' '))"
    short = ", ".join(grams(n) for n in sorted(sizes) if 0 < n < SHINGLE)
    every = f"list_concat({grams(SHINGLE)}, {short})" if short else grams(SHINGLE)
    own = f"CASE WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')] ELSE {grams(SHINGLE)} END"
    split = lambda key, table, found: f"SELECT DISTINCT {key}, unnest({found}) AS gram FROM (SELECT *, {words} AS ws FROM {table})"
    return f"""
WITH given(license, text) AS (VALUES {given}),
t AS ({split('license', 'given', own)}),
size AS (SELECT license, count(*) AS n FROM t GROUP BY license),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS ({split('doc_id', 'd', every)}),
f AS (SELECT doc_id, license FROM g JOIN t USING (gram) JOIN size USING (license) GROUP BY doc_id, license HAVING count(*) >= 0.8 * any_value(n))
SELECT doc_id, coalesce(string_agg(license, ',' ORDER BY license), '') AS licenses, count(license) AS n_licenses FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": _OP1, "op4_line_dedup": _OP4, "op7_license_scan": _op7()}
