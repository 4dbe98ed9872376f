"""Resolving mentions to known entities, and new sources to known ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clauselake.functions import arrays as A
from clauselake.functions import text as X


def name_key(c: Column) -> Column:
    """Name without punctuation, case and legal form; null if nothing is left."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")
    return F.nullif(F.trim(F.regexp_replace(t, r"\b(?:inc|llc|ltd|corp|co|group|company|corporation|limited)\b", " ")), F.lit(""))


def resolve(mentions: DataFrame, id_col: str, name: str, known: DataFrame, known_id: str, known_name: str, aliases: str | None = None) -> DataFrame:
    """(id, entity_id, resolution): resolved if the name's key belongs to one entity, ambiguous for several, else unresolved. One hash join."""
    names = known.select(F.col(known_id).alias("entity_id"), name_key(F.col(known_name)).alias("nk"))
    if aliases:
        names = names.unionAll(known.select(F.col(known_id).alias("entity_id"), F.explode(aliases).alias("a")).select("entity_id", name_key(F.col("a")).alias("nk")))
    k = names.where("nk IS NOT NULL").groupBy("nk").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("entity_id"))
    m = mentions.select(F.col(id_col).alias("id"), name_key(F.col(name)).alias("nk")).join(k, "nk", "left")
    return m.select("id", F.when(F.col("n") == 1, F.col("entity_id")).alias("entity_id"), F.when(F.col("n") == 1, "resolved").when(F.col("n") > 1, "ambiguous").otherwise("unresolved").alias("resolution"))


def source_identity(new: DataFrame, known: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, known_id, outcome) for sources (id, citation, jurisdiction, title, effective_from).

    duplicate: one citation and jurisdiction, not later; new_version: later; needs_review: another citation
    but titles of one jurisdiction overlap by ``least``; else new."""
    norm = lambda c: F.coalesce(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", ""), F.lit(""))
    a = new.select("id", norm(F.col("citation")).alias("c"), norm(F.col("jurisdiction")).alias("j"), X.tokens(F.col("title")).alias("w"), F.col("effective_from").alias("at"))
    b = known.select(F.col("id").alias("known_id"), norm(F.col("citation")).alias("c"), norm(F.col("jurisdiction")).alias("j"), X.tokens(F.col("title")).alias("kw"), F.col("effective_from").alias("kat"))
    last = F.max(F.struct(F.coalesce("kat", F.lit("0001-01-01").cast("date")).alias("kat"), "known_id"))
    same = a.join(b.where("c <> ''").groupBy("c", "j").agg(last.alias("k")), ["c", "j"]).select("id", F.col("k.known_id").alias("known_id"), F.when(F.col("at") > F.col("k.kat"), "new_version").otherwise("duplicate").alias("outcome"), F.lit(1).alias("tier"), F.lit(1.0).alias("s"))
    rest = a.join(same.select("id"), "id", "left_anti")
    words = rest.select("id", "j", "w", F.explode("w").alias("word")).join(b.select("known_id", "j", "kw", F.explode("kw").alias("word")), ["j", "word"]).dropDuplicates(["id", "known_id"])
    near = words.withColumn("s", A.overlap(F.col("w"), F.col("kw"))).where(F.col("s") >= least).select("id", "known_id", F.lit("needs_review").alias("outcome"), F.lit(2).alias("tier"), "s")
    none = rest.select("id", F.lit(None).cast("string").alias("known_id"), F.lit("new").alias("outcome"), F.lit(3).alias("tier"), F.lit(0.0).alias("s"))
    w = W.partitionBy("id").orderBy("tier", F.desc("s"), "known_id")
    return same.unionAll(near).unionAll(none).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("id", "known_id", "outcome")
