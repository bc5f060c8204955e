"""Line dedup: a segment-partition join on edit distance, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import compact, components, stored

#: Rows of one long each that may be sent to every executor; beyond that the join shuffles.
_SMALL = 200_000


def _few(ids: DataFrame) -> DataFrame:
    """A stored table of one long column, marked for broadcast where it has been counted and is small."""
    return F.broadcast(ids) if ids.count() <= _SMALL else ids


def _places(length: Column, edits: int) -> list[tuple[int, Column, Column, Column, bool]]:
    """(segment number, length of the indexed line, start from 0, characters, own segment or only probed with) of each
    piece that segment_keys hashes."""
    out = []
    for shorter in range(edits + 1):
        size = length - shorter
        each = F.floor(size / (edits + 1)).cast("int")
        longer = (size % (edits + 1)).cast("int")  # so many of the last segments have one character more
        for i in range(edits + 1):
            extra = F.greatest(longer - (edits + 1 - i), F.lit(0))
            start, n = each * i + extra, each + (F.lit(edits + 1 - i) <= longer).cast("int")
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + (edits - i))
            # Of two lines of one length whose middle segment moved by a place, one finds the other's a place back.
            high = min(high, 0) if edits == 2 and not shorter else high
            out += [(i, size, start + move, n, not shorter and not move) for move in range(low, high + 1)]
    return out


def wide(line: Column) -> Column:
    """Four bytes a character: a piece of it is cut out by its place, where UTF-8 has to be counted through from the start."""
    return F.encode(line, "UTF-32")


def _key(of: Column, i: int, size: Column, at: Column, n: Column) -> Column:
    return F.xxhash64(F.lit(i), size, F.substring(of, at * 4 + 1, n * 4))


def segment_keys(of: Column, length: Column, edits: int) -> Column:
    """(key, own): hashes of (segment number, length of the indexed line, text), of own segments and of those it looks for.

    ``of`` is the line as ``wide`` gives it, a column already worked out. A line of L characters is cut into
    ``edits + 1`` even segments; one of them stands unchanged in any line within
    ``edits``, moved by at most as many places as there are edits left of it, and right of it. A line of l characters
    so looks for the segments of lines of length l - edits to l at those few places. Of two near lines the longer one
    finds an own segment of the other; at its own length and place that is its own segment too. With 2 edits, the
    middle of lines of one length moves where one of them has a character more on the left and the other one on the
    right: this other one finds the first one's middle a place back, or, if the character more stands right at the
    border, both begin with one segment.
    """
    return F.array(*[F.struct(_key(of, i, size, at, n).alias("key"), F.lit(own).alias("own")) for i, size, at, n, own in _places(length, edits)])


def _pieces(line: Column, of: Column, length: Column, edits: int) -> Column:
    """segment_keys, each with what is left of the line without its piece."""
    return F.array(*[F.struct(
        _key(of, i, size, at, n).alias("key"),
        F.concat(F.substring(line, F.lit(1), at), F.substring(line, at + n + 1, length)).alias("left"), F.lit(own).alias("own"))
        for i, size, at, n, own in _places(length, edits)])


def _common(a: Column, b: Column, longest: Column) -> Column:
    """Length of the common beginning, by halving steps."""
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(longest + 1.0)).cast("int")), lambda p: F.pow(F.lit(2.0), p).cast("int"))
    return F.aggregate(F.reverse(steps), F.lit(0), lambda at, n: F.when(
        (at + n <= longest) & (F.substring(a, at + 1, n) == F.substring(b, at + 1, n)), at + n).otherwise(at))


#: Sets of characters whose counts bound the distance of two lines from below.
_BAGS = ("aA", "eE", "iI", "oOuU", "nN", "tT", "rRsS", "hH", "dDlL", "cCgGmM")


def _bags(line: Column) -> Column:
    """How many characters of each of the sets a line has: one edit changes at most two of the counts, each by one."""
    return F.array(*[F.char_length(line) - F.char_length(F.translate(line, chars, "")) for chars in _BAGS])


def _may_be_near(a: Column, b: Column, edits: int) -> Column:
    gaps = [F.abs(a[i] - b[i]) for i in range(len(_BAGS))]
    return sum(gaps[1:], gaps[0]) <= 2 * edits


def _settled(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns worked out once: through a generator, past which the optimizer doesn't copy an expression to its uses."""
    kept = [c for c in df.columns if c not in columns]
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__made")
    return df.select(*[F.col(f"`{c}`") for c in df.columns], made).select(*[F.col(f"`{c}`") for c in kept], "__made.*")


def within(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """The rows whose two texts are at most ``edits`` insertions, deletions and replacements apart.

    Common beginnings and ends are cut off first. Then one vector for each number of edits e holds, a bit for each
    diagonal of the band, whether the i characters read of one text and the i + d of the other are within e: a match
    keeps a bit, a replacement takes it from e - 1, a deletion moves it down and an insertion up a diagonal. All
    diagonals are taken at once by shifts of the vectors.
    """
    least = F.least(F.char_length("__x"), F.char_length("__y"))
    df = _settled(pairs.where(F.abs(F.char_length(a) - F.char_length(b)) <= edits), __x=F.col(a), __y=F.col(b))
    for _ in range(2):
        df = _settled(df, __n=_common(F.col("__x"), F.col("__y"), least))
        df = _settled(df, **{c: F.reverse(F.substring(c, F.col("__n") + 1, F.char_length(c))) for c in ("__x", "__y")})
    df = _settled(df, **{c: F.filter(F.split(c, ""), lambda c: c != "") for c in ("__x", "__y")})
    y, n = F.col("__y"), F.size("__y")
    band = range(-edits, edits + 1)

    def real(read: Column) -> Column:
        """Diagonals that exist after so many characters."""
        bits = [F.when((read + d >= 0) & (read + d <= n), 1 << (d + edits)).otherwise(0) for d in band]
        out = bits[0]
        for bit in bits[1:]:
            out = out.bitwiseOR(bit)
        return out

    def step(state: Column, x: Column) -> Column:
        i = state["i"]
        same = F.lit(0)
        for d in band:
            same = same.bitwiseOR(F.when(F.coalesce(F.get(y, i + d) == x, F.lit(False)), 1 << (d + edits)).otherwise(0))
        mask, rows = real(i + 1), []
        for e in range(edits + 1):
            row = state[f"r{e}"].bitwiseAND(same)
            if e:
                before = state[f"r{e - 1}"]
                row = row.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
            rows.append(row.bitwiseAND(mask))
        return F.struct((i + 1).alias("i"), *[r.alias(f"r{e}") for e, r in enumerate(rows)])

    # Before the first character, d insertions reach diagonal d.
    opened = [F.lit(sum(1 << (d + edits) for d in range(e + 1))).bitwiseAND(real(F.lit(0))) for e in range(edits + 1)]
    start = F.struct(F.lit(0).alias("i"), *[r.alias(f"r{e}") for e, r in enumerate(opened)])
    last = F.aggregate("__x", start, step, lambda s: s[f"r{edits}"])
    df = df.withColumn("__last", last)
    hit = F.col("__last").bitwiseAND(F.expr(f"shiftleft(1, CAST(size(__y) - size(__x) + {edits} AS INT))")) != 0
    return df.where(hit).select(*pairs.columns)


def line_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 32, short_copies: bool = False) -> DataFrame:
    """doc_id, line_no (from 0), class_doc_id, class_line_no and kept of every line of every document.

    Lines are cut at line feeds. Two lines of ``min_chars`` characters or more are alike when at most ``edits`` edits
    apart; a class holds what is reachable. Its name is its first line, by (doc_id, line_no), and that is kept.
    Shorter lines are classes of their own and always kept; with ``short_copies``, those of one text are one class, empty
    lines included, of which the first is kept. Null texts have no line, empty ones an empty line. Rows of
    one id are one document: their lines of one number are the same place, so repeated rows keep the same lines. A null
    id comes first. Other columns are ignored.

    Copies of a line are one hash, and every count of keys is pre-aggregated on the map side. Keys that two different
    lines share are found first; each line is then verified against the smallest of its key, which joins large families
    without all their pairs. Only pairs of lines in different components come after that, and these must share a second
    key in what is left of them without the first and have nearly equal counts of letters, so a segment that many unlike
    lines share doesn't pair them all.
    """
    lines = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.posexplode(F.split(f"`{text}`", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("n", F.char_length("line"))
    places = stored(lines.select("doc_id", "line_no", F.when(F.lit(short_copies) | (F.col("n") >= min_chars), F.xxhash64("line")).alias("h")), "lines")
    long = lines.where(F.col("n") >= min_chars).select("line", "n", F.xxhash64("line").alias("h"))
    keys = long.select("h", "n", wide(F.col("line")).alias("wide")).select("h", F.inline(segment_keys(F.col("wide"), F.col("n"), edits)))
    met = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bool_or("own").alias("owned")).where("lo < hi AND owned")
    mixed = stored(met.select("key", "lo"), "mixed-keys")
    few = F.broadcast(mixed) if mixed.count() <= _SMALL else mixed
    rows = compact(stored(keys.join(few, "key").groupBy("key", "h", "lo").agg(F.bool_or("own").alias("own")), "shared-keys"))
    wanted = stored(rows.select("h").distinct(), "wanted-lines")
    texts = compact(stored(long.join(_few(wanted), "h").groupBy("h").agg(F.min("line").alias("line")).withColumn("bags", _bags(F.col("line"))), "line-texts"), 20_000)

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("h").alias(side), F.col("line").alias(name), F.col("bags").alias(f"{name}_bags")) for side, name in (("src", "a"), ("dst", "b")))
        both = pairs.join(a, "src").join(b, "dst").where(_may_be_near(F.col("a_bags"), F.col("b_bags"), edits)).drop("a_bags", "b_bags")
        return within(both, "a", "b", edits).select("src", "dst")

    stars = stored(verified(rows.where("h > lo").select(F.col("lo").alias("src"), F.col("h").alias("dst")).distinct()), "line-stars")
    first = components(stars, "line-components")
    placed = rows.select("key", "h", "own").join(first, F.col("h") == F.col("id"), "left").select("key", "h", "own", F.coalesce("component", "h").alias("component"))
    open_ = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = placed.join(open_, "key", "left_semi").join(texts, "h")
    # The second key: what is left of the line without the piece is within the same number of edits.
    rest = rest.withColumn("n", F.char_length("line")).withColumn("wide", wide(F.col("line")))
    left = rest.withColumn("p", F.explode(_pieces(F.col("line"), F.col("wide"), F.col("n"), edits))).where("p.key = key")
    left = left.select("h", "component", "bags", "p.own", F.col("key").alias("outer"), F.col("p.left").alias("left")).distinct()
    left = left.select("h", "component", "bags", "own", "outer", wide(F.col("left")).alias("wide"), F.char_length("left").alias("n"))
    deeper = left.select("h", "component", "bags", "own", "outer", F.inline(segment_keys(F.col("wide"), F.col("n"), edits)).alias("key", "own2"))
    deeper = compact(stored(deeper.withColumn("key", F.xxhash64("outer", "key")).drop("outer").distinct(), "second-keys"))
    a, b = deeper.alias("a"), deeper.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.h") < F.col("b.h")) & (F.col("a.component") != F.col("b.component"))
    near = near & (F.col("a.own") | F.col("b.own")) & (F.col("a.own2") | F.col("b.own2"))
    pairs = a.join(b, near & _may_be_near(F.col("a.bags"), F.col("b.bags"), edits)).select(F.col("a.h").alias("src"), F.col("b.h").alias("dst")).distinct()
    classes = components(stars.unionByName(verified(pairs)), "line-components")

    known = places.join(classes, F.col("h") == F.col("id"), "left").select("doc_id", "line_no", F.coalesce("component", "h").alias("class"))
    place = F.struct("doc_id", "line_no")
    heads = known.where("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("head"))
    named = known.join(heads, "class", "left").withColumn("head", F.coalesce("head", place))
    return named.select("doc_id", "line_no", F.col("head.doc_id").alias("class_doc_id"), F.col("head.line_no").alias("class_line_no"), (place == F.col("head")).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = 2, min_chars: int = 32, drop_short_copies: bool = False) -> DataFrame:
    """The documents without the lines that line_classes doesn't keep; those that had lines and have none left go.

    Columns and order of lines stay. Documents without a repeated line come out as they went in, null texts included.
    Rows of one id lose the lines of the same numbers. Lines under ``min_chars`` stay, however often they repeat, unless
    ``drop_short_copies`` is set.
    """
    none = -(1 << 63)
    gone = line_classes(docs, doc_id, text, edits, min_chars, drop_short_copies).where("NOT kept")
    gone = gone.groupBy(F.coalesce("doc_id", F.lit(none)).alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    rows = docs.withColumn("__id", F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(none))).join(gone, "__id", "left")
    kept = F.filter(F.split(f"`{text}`", "\n"), lambda line, i: ~F.array_contains("__gone", i))
    rows = rows.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    rows = rows.where("__kept IS NULL OR size(__kept) > 0")
    return rows.withColumn(text, F.coalesce(F.array_join("__kept", "\n"), F.col(f"`{text}`"))).select(*[f"`{c}`" for c in docs.columns])
