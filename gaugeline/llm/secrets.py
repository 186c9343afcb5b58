"""Secret scans with multipart credential linking; DataFrame functions only.

Base findings (kinds assign, access, hex) stand on their own.  Parts that are weak alone (identifier, key, endpoint) are
reported only where a complementary part is near, one of the two being a secret (a named value or a key): parts are points on a document's text, and an interval join
over (row, bin) tells for each weak part whether a complementary one lies within SCOPE code points.  The joined side
holds the first and last position per (row, bin, role), which decides the interval exactly: in a part's own bin every
position is within reach, of the bin before the last one matters, of the bin after the first.  So a document with very
many parts costs as many join rows as it has parts, never their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import cut

#: Fixed values of the contract: the base patterns (the least lengths are applied to what they match).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # what [0-9a-f]+ matches with 16 characters or more: its runs are maximal
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

#: Weak parts: named identifiers, long mixed tokens that could be keys, and service addresses.
IDENTIFIER = r"(?i:\b(?:access_?key(?:_?id)?|client_?id|account_?id|user(?:name)?|login)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9@._-]{4,}"
KEY = r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}"
ENDPOINT = r"\b(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:@-]+"
#: Code points within which parts belong together.
SCOPE = 400
#: Array elements that are folded at a time (see _blocks).
BLOCK = 128
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
#: A weak part of a role is reported near a part of one of these roles: one of the linked parts is a secret.
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}

_SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array as arrays of BLOCK elements, so that a fold which grows an array never copies more than a block per element.
    ``items`` has to be a bound value (see _let)."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int"))
    return F.transform(starts, lambda k: F.slice(items, k * BLOCK + 1, BLOCK))


def _placed(text: str, found: str, pattern: str, kind: str, keep=None) -> Column:
    """Spans (in code points) of the matches listed in column ``found``: the gaps between them give their places.

    Places are summed inside blocks, then over blocks, so the work stays in proportion to a text with very many matches.
    """
    gaps = F.arrays_zip(F.transform(F.split(F.col(text), pattern, -1), F.length).alias("gap"), F.transform(F.col(found), F.length).alias("size"))

    def inside(block):
        def move(acc, s):
            at = acc["pos"] + s["gap"]
            end = at + F.coalesce(s["size"], F.lit(0))
            return F.struct(end.alias("pos"), F.when(s["size"].isNotNull(), F.concat(acc["out"], F.array(_span(at, end, kind)))).otherwise(acc["out"]).alias("out"))
        return F.aggregate(block, F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")), move)

    def moved(parts):
        ahead = F.aggregate(parts, F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out")),
                            lambda acc, p: F.struct((acc["pos"] + p["pos"]).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])
        return _let(ahead, lambda first: F.flatten(F.transform(parts, lambda p, k: F.transform(
            p["out"], lambda s: _span(s["start"] + F.get(first, k), s["end"] + F.get(first, k), kind)))))

    spans = _let(gaps, lambda g: _let(F.transform(_blocks(g), inside), moved))
    if keep is not None:
        spans = F.filter(spans, lambda _, k: keep(F.get(k)))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def _apart(weak: str, base: str) -> Column:
    """The weak spans that overlap no base span; base spans are passed over a block at a time."""
    overlaps = lambda s, b: (b["start"] < s["end"]) & (s["start"] < b["end"])
    bounds = F.transform(_blocks(F.col(base)), lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("start"),
                                                                 F.array_max(F.transform(b, lambda x: x["end"])).alias("end"), b.alias("all")))
    return F.when((F.size(weak) == 0) | (F.size(base) == 0), F.col(weak)).otherwise(
        _let(bounds, lambda blocks: F.filter(weak, lambda s: ~F.exists(blocks, lambda b: overlaps(s, b) & F.exists(b["all"], lambda x: overlaps(s, x))))))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _roles(kind: Column) -> Column:
    """A base hex run is a secret only where it is named, and then it lies in an assign span; alone it links nothing."""
    return (F.when(kind.isin("access", "identifier"), "identifier").when(kind == "endpoint", "endpoint")
            .when(kind.isin("assign", "key"), "secret"))


def _linked(rows: DataFrame, scope: int, complements: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rid, added``: the weak parts of each row that have a complementary part in scope."""
    parts = rows.where(F.size("weak") > 0).select("rid", F.explode(F.concat("base", "weak")).alias("s"))
    parts = parts.select("rid", "s", _roles(F.col("s.kind")).alias("role"), F.floor(F.col("s.start") / scope).alias("bin")).where("role is not null")
    near = parts.groupBy("rid", "bin", "role").agg(F.min("s.start").alias("first"), F.max("s.start").alias("last"))
    near = near.select(F.col("rid").alias("nrid"), F.col("role").alias("nrole"), "first", "last", F.col("bin").alias("nbin"),
                       F.explode(F.array(*[F.col("bin") + k for k in (-1, 0, 1)])).alias("reach"))
    needs = F.create_map(*[x for role, of in complements.items() for x in (F.lit(role), F.array(*map(F.lit, of)))])
    weak = (parts.where(F.col("s.kind").isin(*KINDS[3:]))
            .select("rid", "s", "bin", F.explode(needs[F.col("role")]).alias("need")))
    start = F.col("s.start")
    inside = (F.when(F.col("nbin") == F.col("bin"), F.lit(True)).when(F.col("nbin") < F.col("bin"), F.col("last") >= start - scope)
              .otherwise(F.col("first") <= start + scope))
    return (weak.join(near, (F.col("rid") == F.col("nrid")) & (F.col("bin") == F.col("reach")) & (F.col("need") == F.col("nrole")))
            .where(inside).groupBy("rid").agg(F.collect_set("s").alias("added")))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE,
                 carry: bool = False, complements: dict[str, tuple[str, ...]] = COMPLEMENTS) -> DataFrame:
    """``id, spans, base`` per row: arrays of ``(start, ord, end, kind)`` by start and kind, base without the weak parts.

    ``complements`` names, for each role, the roles that a weak part of it is reported near.
    With ``carry`` the row itself comes along as struct ``row``.  Places are code points, ends exclusive.  Defined cases:
    a NULL or empty text has no span; a very long text is read whole, its work in proportion to its length and matches; rows that repeat an id, or have none, are scanned one by one; equal places of
    several kinds come in the kinds' order; an empty table gives no rows; further columns are ignored (or carried).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    kept = ["row"] if carry else []
    seen = docs.select(F.col(f"`{id_col}`").alias("id"), *row, text.alias("t"),
                       *[F.regexp_extract_all(text, F.lit(p), F.lit(k)).alias(name) for name, p, k in
                         (("m_assign", ASSIGN, 0), ("v_assign", ASSIGN, 2), ("m_access", ACCESS, 0), ("m_hex", HEX, 0),
                          ("m_identifier", IDENTIFIER, 0), ("m_key", KEY, 0), ("m_endpoint", ENDPOINT, 0))])
    least = lambda name, n: lambda k: F.length(F.get(F.col(name), k)) >= n
    base = F.array_sort(F.concat(
        F.when(F.size("m_assign") > 0, F.filter(_placed("t", "m_assign", ASSIGN, "assign"), lambda _, k: least("v_assign", MIN_ASSIGN)(k))).otherwise(F.array().cast(_SPAN)),
        F.when(F.size("m_access") > 0, F.filter(_placed("t", "m_access", ACCESS, "access"), lambda s: s["end"] - s["start"] >= MIN_ACCESS)).otherwise(F.array().cast(_SPAN)),
        _placed("t", "m_hex", HEX, "hex")))
    weak = F.concat(*[_placed("t", f"m_{k}", p, k) for k, p in (("identifier", IDENTIFIER), ("key", KEY), ("endpoint", ENDPOINT))])
    found = seen.select("id", *kept, base.alias("base"), weak.alias("weak"))
    # a part that overlaps a base finding is reported by it already
    found = found.select("id", *kept, "base", _apart("weak", "base").alias("weak"))
    rows = cut(found.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    alone = rows.where(F.size("weak") == 0).select("id", *kept, F.col("base").alias("spans"), "base")
    with_weak = rows.where(F.size("weak") > 0).join(_linked(rows, scope, complements), "rid", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(_SPAN))))
    return alone.unionAll(with_weak.select("id", *kept, spans.alias("spans"), "base"))


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns: counts by base kind, the digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("id", *map(count, KINDS[:3]), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start; they may overlap) replaced by ``mask``; one piece of text per block of spans."""
    def inside(block, base, piece):
        def move(acc, s):
            out = F.concat(acc["out"], F.substring(piece, acc["pos"] - base + 1, s["start"] - acc["pos"]), F.lit(mask))
            return (F.when(s["start"] >= acc["pos"], F.struct(s["end"].alias("pos"), out.alias("out")))
                    .otherwise(F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))))
        return F.aggregate(block, F.struct(base.alias("pos"), F.lit("").alias("out")), move)

    def step(acc, block):
        end = F.greatest(acc["pos"], F.array_max(F.transform(block, lambda s: s["end"])))
        piece = F.substring(text, acc["pos"] + 1, end - acc["pos"])
        return _let(piece, lambda own: _let(inside(block, acc["pos"], own), lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out"))))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(_let(spans, _blocks), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
