"""Document fingerprints by Order MinHash, in DataFrame functions alone.

A text becomes k-mers over pieces of its words. Each k-mer gets the number of its occurrence, so repeats differ. A hash of both deals them
into bins; a bin selects its smallest few, keeps them in the order of the text, and hashes that tuple. Two texts agree
in a bin if the same occurrences were selected and stand in the same order, so moved and changed
passages both count, as in an edit distance.

Arrays of k-mers are arrays of 64-bit integers that hold a hash and a place, so that they sort as plain numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigilmesh.llm.common import SPACE

#: Words are cut into pieces of so many characters, and a k-mer is so many pieces.
PIECE, K = 8, 3
#: log2 of the number of bins, and the occurrences a bin selects.
BIN_BITS, SELECTED = 6, 2
#: Bits of a place in the text; what is left is hash.
PLACE_BITS = 28
VALUE_BITS = 64 - BIN_BITS - PLACE_BITS
#: Rows of a stretch of the order that are sorted together, and the most stretches: beyond that many they grow and may spill.
STRETCH, STRETCHES = 2_000, 8_192

PLACE = (1 << PLACE_BITS) - 1
BIN_SHIFT = 64 - BIN_BITS


def _bin(x: Column) -> Column:
    return F.shiftright(x, BIN_SHIFT)


def signature(df: DataFrame, text: str, out: str, k: int = K, selected: int = SELECTED) -> DataFrame:
    """The rows with column `out`: one integer per bin that is not empty, by bin: its number, and 16 bits of its tuple's hash.

    Words are runs of other than white space. A text of fewer than k pieces has one k-mer of all of them; null, empty and
    blank texts have none. Columns of df must not begin with an underscore and a letter.
    """
    get, long = F.get, lambda x: x.cast("long")
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"[^{SPACE}]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn("_p", pieces)
    # Hash of each k-mer above its place.
    kmers = F.transform(
        F.slice("_p", F.lit(1), F.greatest(F.size("_p") - (k - 1), F.lit(1))),
        lambda x, i: F.xxhash64(x, *(get("_p", i + j) for j in range(1, k))).bitwiseAND(F.lit(~PLACE)).bitwiseOR(long(i)),
    )
    df = df.withColumn("_k", F.sort_array(kmers)).drop("_p")

    def starts_run(array, x, i, shift):
        return (i == 0) | (F.shiftright(x, shift) != F.shiftright(get(array, i - 1), shift))

    def numbered(x, occurrence):
        """A hash of the k-mer and the number of its occurrence, above the place."""
        return F.xxhash64(F.shiftright(x, PLACE_BITS), long(occurrence)).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))

    # First occurrences, and all others: these are few, and numbered run by run.
    df = df.withColumn("_again", F.filter("_k", lambda x, i: ~starts_run("_k", x, i, PLACE_BITS)))
    indexes = F.when(F.size("_again") > 0, F.sequence(F.lit(0), F.size("_again") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_runs", F.filter(indexes, lambda i: starts_run("_again", get("_again", i), i, PLACE_BITS)))
    repeats = F.flatten(
        F.transform(
            "_runs",
            lambda s, j: F.transform(
                F.slice("_again", s + 1, F.coalesce(get("_runs", j + 1), F.size("_again")) - s), lambda x, o: numbered(x, o + 1)
            ),
        )
    )
    firsts = F.transform(F.filter("_k", lambda x, i: starts_run("_k", x, i, PLACE_BITS)), lambda x: numbered(x, F.lit(0)))
    df = df.withColumn("_v", F.sort_array(F.concat(firsts, repeats))).drop("_k", "_again", "_runs")
    # The smallest of each bin, then by place within it: the place moves above the value.
    smallest = F.filter("_v", lambda x, i: (i < selected) | (_bin(x) != _bin(get("_v", i - selected))))
    value = lambda x: F.shiftright(x, PLACE_BITS).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
    by_place = F.transform(
        smallest,
        lambda x: x.bitwiseAND(F.lit(-1 << BIN_SHIFT)).bitwiseOR(F.shiftleft(x.bitwiseAND(F.lit(PLACE)), VALUE_BITS)).bitwiseOR(value(x)),
    )
    df = df.withColumn("_o", F.sort_array(by_place)).drop("_v")

    def entry(x, i):
        in_order = lambda y: y.bitwiseAND(F.lit((1 << VALUE_BITS) - 1))
        rest = (F.when(_bin(get("_o", i + j)) == _bin(x), in_order(get("_o", i + j))) for j in range(1, selected))
        digest = F.xxhash64(in_order(x), *rest).bitwiseAND(F.lit(0xFFFF))
        number = F.shiftleft(_bin(x) + F.lit(1 << (BIN_BITS - 1)), 16).bitwiseOR(digest).cast("int")
        return F.when(starts_run("_o", x, i, BIN_SHIFT), number)

    return df.withColumn(out, F.array_compact(F.transform("_o", entry))).drop("_o")


def fingerprint(entries) -> Column:
    """Six hex digits per bin that is not empty: two of its number and four of its hash."""
    return F.array_join(F.transform(entries, lambda e: F.lower(F.lpad(F.hex(e), 6, "0"))), "")


def likeness(a, b) -> Column:
    """Share of bins with equal tuples among those that are not empty in both; 1 if both texts have no k-mer, 0 if one has none."""
    bins = lambda x: F.transform(x, lambda e: F.shiftright(e, 16))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _numbers(values) -> Column:
    """A constant array of integers, short as an expression however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _count_of(bounds: list[int], below) -> Column:
    """How many of the ascending bounds satisfy `below`, which holds for the first ones only: a binary search.

    It folds over its steps. Written out, the count so far stands three times in each step, so that the expression would grow with a power of
    the number of bounds.
    """
    steps, array = (1 << p for p in reversed(range(len(bounds).bit_length()))), _numbers(bounds)
    step = lambda at, by: F.when(below(F.get(array, at + by - 1)), at + by).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if bounds else F.lit(0)


def with_next(documents: DataFrame, payload: list[str], id_column: str = "doc_id", text_column: str = "text", stretch: int = STRETCH) -> DataFrame:
    """The rows with struct `next`: the payload of the next row by descending id, and for the last row that of the first.

    Rows that share an id follow each other by a hash of their text; null ids come last. The order is cut into
    stretches at quantiles of the ids, and an id with many rows at their hashes. The first row of a stretch also
    goes to the end of the stretch before it, so that each is a window of its own and rows are shuffled once.
    """
    rows = documents.withColumns({"_id": F.coalesce(F.col(id_column).cast("long"), F.lit(-(1 << 63))), "_h": F.xxhash64(text_column)})
    n = rows.count()
    cells = max(1, min(STRETCHES, n // stretch))
    bounds = []
    if cells > 1:
        bounds = rows.agg(F.percentile_approx("_id", [i / cells for i in range(1, cells)], 20_000)).first()[0]
    under, upto = _count_of(bounds, lambda b: b < F.col("_id")), _count_of(bounds, lambda b: b <= F.col("_id"))
    # An id that is several bounds has several cells, by its rows' hashes.
    share = F.col("_h").cast("double") / 2.0**64 + 0.5
    rows = rows.withColumns({"_under": under, "_upto": upto}).withColumn(
        "_cell", (F.col("_under") + F.least(F.floor(share * (F.col("_upto") - F.col("_under"))), F.greatest(F.col("_upto") - F.col("_under") - 1, F.lit(0)))).cast("int")
    )
    # The first row of each cell, in descending order: one row of three numbers per cell.
    tops = sorted(rows.groupBy("_cell").agg(F.max(F.struct("_id", "_h")).alias("top")).collect())
    top_id, top_h, to = [0] * cells, [0] * cells, [-1] * cells
    for (cell, top), (after, _) in zip(tops, tops[1:] + tops[:1]):
        top_id[cell], top_h[cell], to[cell] = top["_id"], top["_h"], after
    at = lambda values: F.get(_numbers(values), F.col("_cell"))
    is_top = (F.col("_id") == at(top_id)) & (F.col("_h") == at(top_h))
    place = lambda cell, guest: F.struct(cell.cast("int").alias("cell"), F.lit(guest).alias("guest"))
    own = place(F.col("_cell"), False)
    dealt = rows.withColumn("_at", F.explode(F.when(is_top, F.array(own, place(at(to), True))).otherwise(F.array(own))))
    order = Window.partitionBy("_at.cell").orderBy("_at.guest", F.desc("_id"), F.desc("_h"))
    return (
        dealt.withColumn("next", F.lead(F.struct(*payload)).over(order)).where("NOT _at.guest")
        .drop("_id", "_h", "_under", "_upto", "_cell", "_at")
    )


def edits(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", stretch: int = STRETCH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next per document.

    The edited text is the text whose last floor(n_chars / 3) characters are replaced by the first as many (or all) of the
    next document's by descending id, the first document being next to the last. near_edited and near_next are the likeness of the
    fingerprint to the edited text's and to the next document's. Null text is empty. A text without words has an empty
    fingerprint, which is like another empty one and no other. Rows that share an id are rows of their own and follow each other by a hash of
    their text; a null id comes last. A single row is next to itself, an empty table gives no row. Other columns are
    not read.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    rows = with_next(signature(rows, "text", "entries"), ["text", "entries"], "doc_id", "text", stretch)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_cut", F.floor(F.col("n_chars") / 3).cast("int"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - F.col("_cut")), F.substring(F.col("next.text"), F.lit(1), F.col("_cut")))
    rows = rows.withColumn("edited", edited).select("doc_id", "n_chars", "entries", F.col("next.entries").alias("next_entries"), "edited")
    return signature(rows, "edited", "edited_entries").select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("entries").alias("fingerprint"), fingerprint("edited_entries").alias("edited_fingerprint"),
        likeness("entries", "edited_entries").alias("near_edited"), likeness("entries", "next_entries").alias("near_next"),
    )
