"""Lines of orders in few bytes, for dealing: three longs hold a line whose values are of the usual size and digits, other lines are kept as they are.

The low bits of all values fill two longs; the high ones, which hardly differ from line to line, lie in a third, so that they cost next to nothing where rows are compressed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
WORDS = ["_keys", "_terms", "_high"]
PACKED = [*WORDS, "_odd"]
#: PACKED without a nested column: what passes through Python, where these cost much time.
FLAT = [*WORDS, *[f"_odd_{c}" for c in LINE]]


def _whole(bits: int):
    """Integers from 0 that fit into so many bits."""
    return bits, lambda c: F.when(c.between(0, (1 << bits) - 1), c.cast("long")), lambda n: n


def hundredths(bits: int):
    """Doubles that are exactly the number of so many hundredths."""
    n = lambda c: F.rint(c * 100).cast("long")
    return bits, lambda c: F.when(c.between(0, ((1 << bits) - 1) / 100), F.when(n(c) / 100 == c, n(c))), lambda n: n / 100


def whole_and_hundredths(bits: int):
    """Doubles that are exactly the number of so many hundredths: the whole part in the lowest 8 bits, 7 bits of hundredths above it."""
    _, to, back = hundredths(bits)
    return 15, lambda c: F.call_function("div", to(c), F.lit(100)).bitwiseOR(F.shiftleft(to(c) % 100, 8)), lambda n: back(n.bitwiseAND(F.lit(255).cast("long")) * 100 + F.shiftright(n, 8))


def signed_hundredths(bits: int):
    """Doubles that are exactly the number of so many hundredths, of either sign."""
    half = 1 << (bits - 1)
    n = lambda c: F.rint(c * 100).cast("long")
    return bits, lambda c: F.when(c.between(-half / 100, (half - 1) / 100), F.when(n(c) / 100 == c, n(c) + half)), lambda n: (n - half) / 100


def _letter(letters: str):
    def place(c):
        out = F
        for n, letter in enumerate(letters):
            out = out.when(c == letter, F.lit(n).cast("long"))
        return out

    return (len(letters) - 1).bit_length(), place, lambda n: F.substring(F.lit(letters), n.cast("int") + 1, F.lit(1))


def _midnight(kind):
    """Days from 1970, of times without hours."""
    day = lambda c: F.to_date(c)
    fits = lambda c: F.unix_date(day(c)).between(0, 65_535) & (day(c).cast(kind) == c)
    return 16, lambda c: F.when(fits(c), F.unix_date(day(c)).cast("long")), lambda n: F.date_from_unix_date(n.cast("int")).cast(kind)


def _layout(schema) -> dict[str, list]:
    """By word, its fields from the lowest bits on: name, low bits (the others go to the last word), bits, to a long (null where it does not fit), back."""
    return {
        "_keys": [("l_orderkey", 26, *_whole(36)), ("l_suppkey", 17, *_whole(27)), ("l_partkey", 21, *_whole(33))],
        "_terms": [
            ("l_extendedprice", 24, *hundredths(30)), ("l_linenumber", 3, *_whole(4)), ("l_quantity", 6, *whole_and_hundredths(14)), ("l_discount", 4, *hundredths(7)), ("l_tax", 4, *hundredths(7)),
            ("l_returnflag", 2, *_letter("ANR")), ("l_linestatus", 1, *_letter("FO")), ("l_shipdate", 12, *_midnight(schema["l_shipdate"].dataType)),
        ],
    }


def joined(cells: list[tuple[int, Column]]) -> Column:
    """One long of several by their bits, the lowest first; null if one is."""
    out, at = None, 0
    for bits, cell in cells:
        part = F.shiftleft(cell, at)
        out, at = part if out is None else out.bitwiseOR(part), at + bits
    return out


def cell(word: str | Column, at: int, bits: int) -> Column:
    return F.shiftright(word, at).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def whole(word: str | Column, at: int, low: int, rest: str | Column, rest_at: int, bits: int) -> Column:
    """A value whose low bits lie in word and whose others lie in rest."""
    return cell(word, at, low).bitwiseOR(F.shiftleft(cell(rest, rest_at, bits - low), low)) if bits > low else cell(word, at, low)


class Packing:
    """Lines of one schema: pack() makes PACKED of them, columns gives each column of LINE back."""

    def __init__(self, schema):
        self.words = _layout(schema)
        self.columns, self.schema, high = {}, schema, 0
        for word, fields in self.words.items():
            at = 0
            for name, low, bits, _, back in fields:
                kind = schema[name].dataType
                self.columns[name] = F.when(F.col("_odd").isNull(), back(whole(word, at, low, WORDS[-1], high, bits)).cast(kind)).otherwise(F.col("_odd")[name])
                at, high = at + low, high + bits - low

    def pack(self, rows: DataFrame, more: list[str] = ()) -> DataFrame:
        fields = [f for fields in self.words.values() for f in fields]
        rows = rows.select(*LINE, *[to(F.col(name)).alias(f"_{name}") for name, _, _, to, _ in fields], *more)
        words = [joined([(low, cell(f"_{name}", 0, low)) for name, low, *_ in fields]).alias(word) for word, fields in self.words.items()]
        high = joined([(bits - low, F.shiftright(f"_{name}", low)) for name, low, bits, *_ in fields if bits > low])
        rows = rows.select(*LINE, *words, high.alias(WORDS[-1]), *more)
        fits = F.col(WORDS[0]).isNotNull() & F.col(WORDS[1]).isNotNull()  # each value has low bits
        return rows.select(*[F.when(fits, F.col(w)).alias(w) for w in WORDS], F.when(~fits, F.struct(*LINE)).alias("_odd"), *more)

    def unpacked(self, rows: DataFrame, names: list[str] = LINE) -> DataFrame:
        """rows with these columns of LINE besides."""
        return rows.select("*", *[self.columns[n].alias(n) for n in names])

    def flat(self, rows: DataFrame) -> DataFrame:
        """rows with FLAT for PACKED."""
        return rows.select("*", *[F.col("_odd")[c].alias(f"_odd_{c}") for c in LINE]).drop("_odd")

    def folded(self, rows: DataFrame) -> DataFrame:
        """rows with PACKED for FLAT."""
        odd = F.when(F.col("_keys").isNull(), F.struct(*[F.col(f"_odd_{c}").alias(c) for c in LINE]))
        return rows.select(*[c for c in rows.columns if not c.startswith("_odd_")], odd.alias("_odd"))
