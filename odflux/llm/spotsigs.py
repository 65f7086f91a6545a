"""SpotSigs fingerprints, by DataFrame functions only.

A spot signature is a common word (the anchor) with the chain of the next two content words; of several anchors in a
row the last one counts.  A text's fingerprint is its set of distinct signatures, hashed to 32 bits, sorted and joined
into one string; likeness is the Jaccard similarity of two sets.  A text without any signature has one signature of its
own, the hash of the whole text, so that only equal texts of this kind are alike.

``similar_pairs`` finds alike fingerprints: sets are partitioned by length so that alike sets lie in the same partition
or the next, candidates share one of a set's rarest signatures, as many as the threshold leaves room for, and pairs whose lengths alone rule out the threshold are pruned before the sets meet.

Defined cases: a null text is empty; a null id sorts first; equal (id, text) rows count as one document when the next
document is looked for and each keeps its row; the last document's successor is the first, which for one document is
itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odflux.llm._common import global_row_number

#: Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous on ou par pas pour que qui sa se ses son sur un une vous "
    "als auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sich sie sind so und von war werden wie wir zu zum zur "
    "al como con del el ella ellos en era es esta este los las lo más no o para pero por se sin su sus una y"
)
CHAIN = 2
GROUP = 1000


def _anchor_words() -> str:
    return "|".join(sorted(set(ANCHORS.split()), key=lambda w: (-len(w), w)))


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit signatures of a non-null text."""
    plain = F.concat(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "), F.lit(" "))
    units = F.regexp_extract_all(plain, F.lit(rf"(?<!\p{{L}})(?:(?:{_anchor_words()}) )*+\p{{L}}+"), F.lit(0))
    return F.transform(F.array(units), _chains)[0]


def _chains(units: Column) -> Column:
    after = F.slice(units, F.lit(2), F.size(units))
    spot = lambda a, b: F.when(b.isNotNull() & (F.instr(a, " ") > 0), F.hash(F.substring_index(a, " ", -CHAIN), F.substring_index(b, " ", -1)))
    return F.sort_array(F.array_distinct(F.array_compact(F.zip_with(units, after, spot))))


def with_signatures(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """``df`` with the signature set of a non-null text column, never empty."""
    found = df.withColumn(name, signatures(F.col(text_col)))
    return found.withColumn(name, F.when(F.size(name) > 0, F.col(name)).otherwise(F.array(F.hash(F.col(text_col), F.lit("whole text")))))


def fingerprint(sigs: Column) -> Column:
    return F.array_join(sigs.cast("array<string>"), ",")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.transform(F.array(both), lambda k: k / (F.size(a) + F.size(b) - k))[0].cast("double")


def length_partition(size: Column, threshold: float = 0.75) -> Column:
    """Partitions whose borders grow by 1 / threshold: alike sets are in the same one or the next."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / threshold))).cast("int")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and its likeness to that and to the next document.

    Neighbours are found from narrow rows.  Texts are shuffled once by their key; the part of a text that its
    predecessor takes over, and its signatures, travel once more.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))
    ids = base.groupBy("doc_id", "_h").agg(F.max(F.char_length("text")).alias("n"))
    numbered, total = global_row_number(ids, ["doc_id", "_h"], "rn")
    here = numbered.select(F.col("doc_id").alias("d0"), F.col("_h").alias("h0"), F.expr("n div 2").cast("int").alias("half"), ((F.col("rn") + 1) % max(total, 1)).alias("rn"))
    link = here.join(numbered.select(F.col("doc_id").alias("d1"), F.col("_h").alias("h1"), "rn"), "rn").drop("rn")
    donors = base.join(link, F.col("doc_id").eqNullSafe(F.col("d1")) & (F.col("_h") == F.col("h1")))
    donors = with_signatures(donors.select("d0", "h0", "half", "text"), "text", "next_sigs")
    donors = donors.select("d0", "h0", F.substring("text", F.lit(1), F.col("half")).alias("donor"), "next_sigs").dropDuplicates(["d0", "h0"])
    met = base.join(donors, F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("_h") == F.col("h0")))
    n = F.char_length("text")
    edited = met.withColumn("edited", F.concat(F.substring("text", F.lit(1), (n - F.expr("length(text) div 2")).cast("int")), F.col("donor")))
    signed = with_signatures(with_signatures(edited, "text", "sigs"), "edited", "edited_sigs")
    return signed.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
        length_partition(F.size("sigs")).alias("length_partition"),
    )


def similar_pairs(df: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): alike pairs of distinct fingerprints by their smallest ids, and each document's representative.

    Sets are told apart by their keys, so an id with several texts, or null, loses no pair; a set of null ids only has null.
    """
    base = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = with_signatures(base, "text", "sigs").select("doc_id", "sigs").withColumn("key", F.xxhash64("sigs"))
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("sigs").alias("sigs"))
    members = signed.select("doc_id", "key").join(classes.select("key", "rep"), "key").select("doc_id", "rep")
    sets = classes.select("key", "sigs", F.size("sigs").alias("n")).withColumn("part", length_partition(F.col("n"), threshold))
    room = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    spread = sets.select("key", "n", "part", room.alias("room"), F.explode("sigs").alias("sig"))
    often = spread.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ordered = spread.join(often, "sig").groupBy("key", "n", "part", "room").agg(F.sort_array(F.collect_list(F.struct("often", "sig"))).alias("s"))
    tokens = ordered.select("key", "n", "part", F.explode(F.slice("s", F.lit(1), F.col("room"))).alias("s")).select("key", "n", "part", "s.sig")
    left = tokens.select(F.col("key").alias("ka"), F.col("n").alias("na"), F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "sig")
    right = tokens.select(F.col("key").alias("kb"), F.col("n").alias("nb"), "part", "sig")
    # sets of a group are dealt over cells of at most GROUP of them, and every other set of the group meets each cell
    cells = right.groupBy("part", "sig").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("cells"))
    left = left.join(cells, ["part", "sig"]).withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells")
    right = right.join(cells, ["part", "sig"]).withColumn("cell", F.pmod(F.xxhash64("kb"), F.col("cells")).cast("int")).drop("cells")
    fits = (F.col("na") >= threshold * F.col("nb")) & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("ka") < F.col("kb")))
    pairs = left.join(right, ["part", "sig", "cell"]).where(fits).select("ka", "kb").distinct()
    a, b = (classes.select(F.col("key").alias(f"k{x}"), F.col("rep").alias(x), F.col("sigs").alias(f"s{x}")) for x in "ab")
    scored = pairs.join(a, "ka").join(b, "kb").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity"))
    return scored.where(F.col("similarity") >= threshold), members
