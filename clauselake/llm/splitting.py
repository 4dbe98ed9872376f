"""Oversized texts cut into overlapping pieces at natural boundaries.

One regular expression with bounded quantifiers tiles the text: its alternatives, from the strongest
boundary to the weakest, each take as much as the limit allows - to the end of the text, to the last
paragraph break, sentence end or white space within reach, else exactly the limit. A tile leaves room
for the overlap, but takes that room before a paragraph, sentence or word that fits is cut inside. The
tiles, put together, are the text. Each piece after the first is preceded by a lookback of at most ``overlap``
characters from the end of the tile before, from the start of a word where there is one. Everything is
Spark SQL array functions on the JVM; no shuffle but the folding of repeated rows.

Characters are code points. White space is Unicode white space and the separators 0x1c-0x1f. A
paragraph break is a form feed or a line of only blanks, tabs and carriage returns; a sentence ends at
``.``, ``!`` or ``?`` followed by white space. Cuts stand behind the white space they use (a paragraph
cut behind the line end before the blank line), so that no character is lost.

Edge cases: null and empty texts and texts within the limit are one piece (``split_oversized`` leaves
them out); rows with a null or blank key are ignored; repeated rows of one key count once (the larger
text if they disagree); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.functions.keys import key

_S = r"[\s\x1c-\x1f]"
_BREAK = r"\f|(?:^|\n)(?:[ \t\r]*(?:\n|$))+"


def _tiles(limit: int, overlap: int) -> str:
    run = rf"[\s\S]{{1,{limit - overlap}}}"
    longer = rf"[\s\S]{{{limit - overlap + 1},{limit}}}?" if overlap else run
    paragraph = rf"(?<=[\n\f])(?:(?<=\f)|(?=[ \t\r]*\n))(?<=\S\s{{0,64}})"
    return "(?U)" + "|".join([
        rf"{run}\z",
        rf"{run}{paragraph}",
        rf"{longer}(?:\z|{paragraph})",
        rf"{run}(?<=[.!?]{_S})",
        rf"{longer}(?<=[.!?]{_S})",
        rf"{run}(?<={_S})",
        rf"{longer}(?<={_S})",
        run,
    ])


def _units(limit: int) -> str:
    """Tiles of at most limit characters between their surrounding white space, each up to the last boundary of the strongest kind in reach."""
    run = rf"[\s\S]{{1,{limit}}}(?<!{_S})"
    return rf"(?U){_S}*+(?:" + "|".join([
        rf"{run}(?={_S}*+\z)",
        rf"{run}(?={_S}*?(?:\f|\n[ \t\r]*(?:\n|\z)))",
        rf"{run}(?<=[.!?])(?={_S})",
        rf"{run}(?={_S})",
        rf"[\s\S]{{1,{limit}}}",
    ]) + rf"){_S}*+"


def finest_cut(text: Column, limit: int) -> Column:
    """The weakest boundary that the tiles of a text had to use: paragraph, sentence, word or char."""
    units = F.regexp_extract_all(text, F.lit(_units(limit)), F.lit(0))
    inner = F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0)))  # the last tile ends with the text
    kind = lambda t: (
        F.when(t.rlike(rf"(?U)(?:\f|\n[ \t\r]*\n){_S}*\z"), 0).when(t.rlike(rf"(?U)[.!?]{_S}+\z"), 1).when(t.rlike(rf"(?U){_S}\z"), 2).otherwise(3)
    )
    weakest = F.element_at(F.array(*[F.lit(x) for x in ("paragraph", "sentence", "word", "char")]), F.coalesce(F.array_max(F.transform(inner, kind)), F.lit(0)) + 1)
    return F.when(text.rlike(rf"(?U)\A{_S}*+\z"), "paragraph").otherwise(weakest)


def tiles(text: Column, limit: int, overlap: int) -> Column:
    """The text cut into array elements of at most limit - overlap characters, or up to limit where a unit would be cut else."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    return F.regexp_extract_all(text, F.lit(_tiles(limit, overlap)), F.lit(0))


def lookbacks(tile: Column, limit: int, overlap: int) -> Column:
    """For each tile what the next piece has room to repeat of it: its tail from the first word that starts there, a tail without one whole."""
    room = lambda i: F.least(F.lit(overlap), limit - F.length(F.get(tile, i + 1)))
    tail = lambda t, i: F.when(F.length(t) <= room(i), t).otherwise(F.right(t, room(i)))
    return F.transform(tile, lambda t, i: F.coalesce(F.nullif(F.regexp_extract(tail(t, i), rf"(?U){_S}(\S[\s\S]*)\z", 1), F.lit("")), tail(t, i)) if overlap else F.lit(""))


def starts(tile: Column) -> Column:
    return F.aggregate(F.transform(tile, F.length), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def pieces(tile: Column, back: Column, start: Column) -> Column:
    """array<struct<piece_no, start_at, overlap, cut, piece_text>>, from columns (not expressions: each element reads them)."""
    kind = lambda t, last: (
        F.when(last, "end").when(t.rlike(r"\f\z"), "paragraph").when(t.rlike(rf"(?U)[.!?]{_S}\z"), "sentence").when(t.rlike(rf"(?U){_S}\z"), "word").otherwise("char")
    )

    def piece(t: Column, i: Column) -> Column:
        nxt = F.get(tile, i + 1)
        before = F.when(i > 0, F.get(back, i - 1)).otherwise("")
        cut = F.when(nxt.isNotNull() & t.endswith("\n") & nxt.rlike(r"\A[ \t\r]*\n"), "paragraph").otherwise(kind(t, nxt.isNull()))
        return F.struct(
            (i + 1).alias("piece_no"), (F.get(start, i) - F.length(before)).alias("start_at"), F.length(before).alias("overlap"),
            cut.alias("cut"), F.concat(before, t).alias("piece_text"))

    return F.transform(tile, piece)


def oversized(df: DataFrame, key_col: str, text_col: str, limit: int) -> DataFrame:
    """(row_key, text) of the texts over the limit, each key once; only these are shuffled."""
    k = key(F.col(key_col))
    rows = df.where((F.length(text_col) > limit) & k.isNotNull()).select(k.alias("k"), F.col(key_col).alias("id"), F.col(text_col).alias("text"))
    return rows.groupBy("k").agg(F.min("id").alias("row_key"), F.max("text").alias("text")).select("row_key", "text")


def finest_cuts(df: DataFrame, key_col: str, text_col: str, limit: int) -> DataFrame:
    """(row_key, finest_cut) of every text over the limit, from its tiles without overlap."""
    return oversized(df, key_col, text_col, limit).select("row_key", finest_cut(F.col("text"), limit).alias("finest_cut"))


def split_oversized(df: DataFrame, key_col: str, text_col: str, limit: int, overlap: int = 200) -> DataFrame:
    """(row_key, finest_cut, n_pieces, pieces) for every text over the limit."""
    cut = oversized(df, key_col, text_col, limit).withColumn("tiles", tiles(F.col("text"), limit, overlap))
    cut = cut.withColumn("back", lookbacks(F.col("tiles"), limit, overlap)).withColumn("starts", starts(F.col("tiles")))
    return cut.select(
        "row_key", finest_cut(F.col("text"), limit).alias("finest_cut"), F.size("tiles").alias("n_pieces"),
        pieces(F.col("tiles"), F.col("back"), F.col("starts")).alias("pieces"))
