"""Fill-in-the-middle transformation with one counted-quantifier match per text.

``regexp_count`` gives the number of tokens n of a text. Two cut points a <= b
follow from a hash of the document id. A pattern made for the row,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*)\\z``, then captures prefix, middle and
suffix in one match, and the same match writes the output. The counted groups
are possessive, so the match runs once over the text, without a way back and
without recursion: its cost and stack do not follow the number of tokens.

Everything is a built-in column expression; there is no shuffle.

Defined results: a null text counts as empty, and an empty text is plain with
n = 0. A null id hashes as the empty text after the seed. Texts that hold one of
the three marks stay plain, so that the output can be read back exactly. Rows
stand alone: repeated rows give repeated results, an empty table an empty one.
Very long texts need memory for their token list during the count, about ten
times the text. Of other columns nothing is read or returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a token: white space and what follows it, or white space at the end
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PRE, SUF, MID = "<P>", "<S>", "<M>"


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers: the first digits of sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80,
              doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, n, form, output) of every row; ``form`` is plain, psm or spm.

    A text is transformed in ``fim_percent`` of the rows, and ``spm_percent`` of those put the suffix first.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"))
    df = df.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    df = df.withColumn("h", F.array(*draws(F.col("doc_id"), seed)))
    marked = F.lit(False)
    for mark in (PRE, SUF, MID):
        marked = marked | F.contains("text", F.lit(mark))
    cuts = [F.col("h")[i] % (F.col("n") + 1) for i in (0, 1)]
    form = (F.when((F.col("n") == 0) | marked | (F.col("h")[2] % 100 >= fim_percent), "plain")
            .when(F.col("h")[3] % 100 < spm_percent, "spm").otherwise("psm"))
    df = df.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))

    def counted(times: Column) -> list[Column]:
        return [F.lit(f"((?:{UNIT}){{"), times.cast("string"), F.lit("}+)")]

    pattern = F.concat(F.lit(r"(?s)\A"), *counted(F.col("a")), *counted(F.col("b") - F.col("a")), F.lit(r"(.*)\z"))
    order = F.when(F.col("form") == "spm", f"{SUF}$3{PRE}$1{MID}$2").otherwise(f"{PRE}$1{SUF}$3{MID}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return df.select("doc_id", "text", "n", "form", output.alias("output"))


def parts(output: Column, form: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix) read back from a transformed output."""
    middle = F.substring_index(output, MID, -1)
    head = F.substring_index(output, MID, 1)
    inner = F.when(form == "spm", F.lit(PRE)).otherwise(F.lit(SUF))
    at = F.position(inner, head)
    first = F.substr(head, F.lit(len(PRE) + 1), at - len(PRE) - 1)
    second = F.substr(head, at + len(PRE))
    return F.when(form == "spm", second).otherwise(first), middle, F.when(form == "spm", first).otherwise(second)


def restored(output: Column, form: Column) -> Column:
    """The exact text from output and form."""
    prefix, middle, suffix = parts(output, form)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))


def report(docs: DataFrame) -> DataFrame:
    """Digest per document: form, lengths in code points, hashes of the output and of the text restored from it."""
    df = transform(docs).drop("text")
    prefix, middle, _ = parts(F.col("output"), F.col("form"))
    size = [F.when(F.col("form") != "plain", F.char_length(c).cast("long")) for c in (prefix, middle)]
    return df.select("doc_id", "n", "form", size[0].alias("prefix_chars"), size[1].alias("middle_chars"),
                     F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                     F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tok,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex
  FROM documents
), h AS (
  SELECT *, CAST(len(tok) AS BIGINT) AS n,
         CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2,
         CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, coalesce(array_to_string(tok[1:a], ''), '') AS prefix,
         coalesce(array_to_string(tok[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(tok[b + 1:n], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                        ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
