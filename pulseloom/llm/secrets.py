"""Secret scan with built-in expressions only.

Three pattern kinds give the base spans. On top, every candidate string (a maximal run of
one character class) is read through a sliding window whose character counts are kept and
updated, one in, one out; windows whose Shannon entropy reaches the class threshold are merged into
further spans, unless the candidate is on the allow-list.

Spans are code points, end exclusive. A null text counts as empty: no spans, and the hash
is that of the empty string. Repeated rows give repeated results; columns of the input other
than the id and text columns are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern kinds in their order and the least length of each.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Matches that are placed at a time.
BLOCK = 512


@dataclass(frozen=True)
class EntropyClass:
    """A character class: alphabet, window length and least entropy in bits (to a rounding of 1e-9)."""

    kind: str
    alphabet: str
    window: int
    bits: float


HEX_CLASS = EntropyClass("entropy_hex", "0123456789abcdefABCDEF", 24, 3.0)
BASE64_CLASS = EntropyClass(
    "entropy_base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 24, 3.9
)
#: Candidates that match one of these are no secrets: prose or paths without digits, plain
#: numbers, placeholders, and words of documentation.
ALLOW = (r"^[A-Za-z+/_-]+$", r"^[0-9+/_-]+$", r"(.)\1{7}", r"(?i)example|placeholder|changeme|lorem|xxxx")


def _spans(text: Column, pattern: str, guard: Column, kind: str, order: int, keep) -> Column:
    """array<struct<s,o,kind,e,m>> of the pattern's matches for which keep(match, index) holds.

    The text between matches (split) and the matches alternate, so running lengths give the
    positions that regexp functions do not return."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("b"), F.coalesce(F.length(m), F.lit(0)).alias("m")))
    empty = F.expr("cast(array() as array<struct<s:int,e:int>>)")

    def step(acc: Column, x: Column) -> Column:
        s, e = acc["at"] + x["b"], acc["at"] + x["b"] + x["m"]
        return F.struct(e.alias("at"), F.array_append(acc["got"], F.struct(s.alias("s"), e.alias("e"))).alias("got"))

    def block(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("got")), step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["got"], d["got"]).alias("got"))), F.lit(0))

    # an array grows by copying, so the matches of a text with many are placed in blocks
    blocks = F.get(F.transform(F.array(lengths), lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(all_, k, BLOCK))), F.lit(0))
    placed = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), empty.alias("got")), block, lambda acc: acc["got"])
    rows = F.zip_with(
        placed, found,
        lambda p, m: F.struct(p["s"].alias("s"), F.lit(order).alias("o"), F.lit(kind).alias("kind"), p["e"].alias("e"), m.alias("m")),
    )
    kept = F.filter(rows, lambda r, i: r["m"].isNotNull() & keep(r["m"], i))
    return F.when(guard, kept).otherwise(F.expr("cast(array() as array<struct<s:int,o:int,kind:string,e:int,m:string>>)"))


def _window_sql(c: EntropyClass) -> str:
    """SQL for the merged windows of high entropy in the candidate r, as array<struct<s,e>>.

    The state holds the counts of the window's characters, a byte for each ASCII code in `n`, and in
    `sum` the sum of k*log2(k) over them. A step adds one to the count of the character that enters
    and takes one from that of the character that leaves."""
    w = c.window
    weight = "array(" + ",".join(f"{k}D * log2({max(k, 1)}D)" for k in range(w + 2)) + ")"
    byte = "array(" + ",".join(f"X'{k:02X}'" for k in range(w + 2)) + ")"
    empty = "X'" + "00" * 128 + "'"
    code = lambda at: f"ascii(cast(substr(a.bytes, {at}, 1) as string))"

    def counted(state: str, x: str, by: int, v: str) -> str:
        """The state with `by` added to the count of the character code x; v: a letter for its variables."""
        return f"""aggregate(array({x}), {state}, ({v}, {v}x) -> aggregate(array(ascii(cast(substr({v}.n, {v}x + 1, 1) as string))), {v}, ({v}s, {v}k) ->
            named_struct('bytes', {v}s.bytes, 'n', overlay({v}s.n PLACING {byte}[{v}k + {by}] FROM {v}x + 1 FOR 1), 'sum', {v}s.sum + {weight}[{v}k + {by}] - {weight}[{v}k], 'got', {v}s.got)))"""

    last = "b.got[greatest(size(b.got) - 1, 0)]"
    entered = counted("a", code("i + 1"), 1, "p")
    left = counted("e", code(f"i - {w - 1}"), -1, "q")
    return f"""
      aggregate(
        sequence(0, length(r.m) - 1),
        named_struct('bytes', cast(r.m as binary), 'n', {empty}, 'sum', 0D, 'got', cast(array() as array<struct<s:int,e:int>>)),
        (a, i) -> aggregate(
          array(0), aggregate(if(i >= {w}, array(0), cast(array() as array<int>)), {entered}, (e, g) -> {left}), (b, h) -> b,
          b -> named_struct('bytes', b.bytes, 'n', b.n, 'sum', b.sum, 'got',
            if(i < {w - 1} or log2({w}D) - b.sum / {w}D < {c.bits}D - 1e-9D, b.got,
              if(size(b.got) > 0 and {last}.e >= r.s + i - {w - 1},
                 concat(slice(b.got, 1, size(b.got) - 1), array(named_struct('s', {last}.s, 'e', r.s + i + 1))),
                 concat(b.got, array(named_struct('s', r.s + i - {w - 1}, 'e', r.s + i + 1))))))),
        a -> a.got)
    """


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[EntropyClass, ...] = (HEX_CLASS, BASE64_CLASS), allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """Per row: the id, `base` and `added` (arrays of spans with position, kind and string)."""
    df = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = F.col("_t")
    second = F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))
    # [..]+ of at least n characters, leftmost and maximal, is the same as [..]{n,} for a single run
    assign = _spans(t, ASSIGN, t.rlike(ASSIGN), "assign", 1, lambda m, i: F.length(F.get(F.col("_g2"), i)) >= MIN_ASSIGN)
    access = _spans(t, r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), t.contains("AKIA"), "access", 2, lambda m, i: F.lit(True))
    hexes = _spans(t, r"[0-9a-f]{%d,}+" % MIN_HEX, t.rlike(r"[0-9a-f]{%d}" % MIN_HEX), "hex", 3, lambda m, i: F.lit(True))
    df = df.withColumn("_g2", F.when(t.rlike(ASSIGN), second))
    df = df.withColumn("base", F.concat(assign, access, hexes))
    for k, c in enumerate(classes):
        run = "[" + c.alphabet.replace("-", r"\-") + "]"
        pattern = f"(?<!{run}){run}{{{c.window},}}+"
        refused = lambda m: F.exists(F.array(*[F.lit(a) for a in allow]), lambda a: F.regexp(m, a))
        df = df.withColumn(f"_c{k}", _spans(t, pattern, t.rlike(pattern), c.kind, 4 + k, lambda m, i: ~refused(m)))
    added = [
        F.flatten(F.expr(f"transform(_c{k}, r -> transform({_window_sql(c)}, v -> named_struct('s', v.s, 'o', {4 + k}, 'kind', '{c.kind}', 'e', v.e, 'm', substr(r.m, v.s - r.s + 1, v.e - v.s))))"))
        for k, c in enumerate(classes)
    ]
    df = df.withColumn("added", F.concat(*added) if added else F.expr("cast(array() as array<struct<s:int,o:int,kind:string,e:int,m:string>>)"))
    return df.select(id_col, "base", "added")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the hash of the base spans and the string of all spans."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda r: F.concat_ws(":", r["kind"], r["s"].cast("string"), r["e"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda r: r["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_entropy"),
    )
