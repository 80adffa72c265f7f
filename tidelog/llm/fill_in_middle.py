r"""Fill-in-middle examples, cut and put together by one match of a pattern made for each row.

A text is tiled by units (white space and the word behind it, or white space alone). `regexp_count` gives
their number n, two numbers drawn from a hash of the id give cuts 0 <= a <= b <= n, and the row's own
pattern, (unit{a}+)(unit{b-a}+)(rest) with possessive counts, captures prefix, middle and suffix in one
match; the replacement of that match is the output. A possessive group is matched in a loop, without
recursion and without going back, so a text of any length takes time in proportion to it.

Forms: `psm` is <P>prefix<S>suffix<M>middle, `spm` is <S>suffix<P>prefix<M>middle, `plain` is the text
itself. A text that is empty or holds a marker stays plain, so in the other forms each marker stands once
and the text is rebuilt exactly from output and form (`restore`). No row is shuffled: every column is an
expression of its own row.

Defined results: a null text is empty; a null id is the empty text where it is hashed. Repeated rows are
transformed alike. An empty table gives no rows. Other columns of the input are neither read nor returned,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import read_table

#: White space and a word, or white space without one: these tile every text.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draw(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th (from 0) 8-digit group of the hex sha256 of seed:id, as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int, rate: int, spm_rate: int) -> DataFrame:
    """doc_id, n, form, output. rate: of 100 texts, how many are cut; spm_rate: of 100 of these, how many are spm."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"), *(draw(seed, F.col("doc_id"), k).alias(f"h{k + 1}") for k in range(4)))
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    a, b = F.least(x, y), F.greatest(x, y)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm")
    unit = lambda count: F.concat(F.lit(f"({UNIT}{{"), count.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), unit(a), unit(b - a), F.lit(r"([\x{0}-\x{10FFFF}]*+)\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    cut = rows.select("doc_id", "text", "n", form.alias("form"), pattern.alias("pattern"))
    return cut.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", F.col("pattern"), order)).alias("output"))


def parts(output: Column, form: Column) -> dict[str, Column]:
    """prefix, middle and suffix of an output; null where it is plain."""
    head = F.substring_index(output, MIDDLE, 1)
    inner = F.when(form == "psm", F.struct(F.substring_index(head, SUFFIX, 1).alias("p"), F.substring_index(head, SUFFIX, -1).alias("s"))).when(
        form == "spm", F.struct(F.substring_index(head, PREFIX, -1).alias("p"), F.substring_index(head, PREFIX, 1).alias("s"))
    )
    unmark = lambda part, marker: F.when(part.startswith(marker), F.right(part, F.length(part) - len(marker))).otherwise(part)
    return {"prefix": unmark(inner["p"], PREFIX), "middle": F.when(form != "plain", F.substring_index(output, MIDDLE, -1)), "suffix": unmark(inner["s"], SUFFIX)}


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    p = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(p["prefix"], p["middle"], p["suffix"]))


#: Of the query.
SEED, RATE, SPM_RATE = 42, 50, 80


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs of all documents, and of the texts rebuilt from them."""
    made = transform(read_table(spark, sf_dir, "documents"), SEED, RATE, SPM_RATE)
    p = parts(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.length(p["prefix"]).cast("long").alias("prefix_chars"), F.length(p["middle"]).cast("long").alias("middle_chars"),
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS us, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
),
d AS (
  SELECT *, CAST(len(us) AS BIGINT) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(us) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(us) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
),
c AS (
  SELECT *, array_to_string(us[1:least(x, y)], '') AS p, array_to_string(us[least(x, y) + 1:greatest(x, y)], '') AS m, array_to_string(us[greatest(x, y) + 1:n], '') AS s FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM c
"""
