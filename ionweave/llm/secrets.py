"""Secrets by patterns and multipart credential linking, with DataFrame functions only.

Base spans come from three patterns. Weaker parts - identifiers (user names, client ids), secrets (short assignments,
tokens with upper and lower case and digits) and endpoints (urls of hosts and databases) - are candidates. Scopes are
the stretches within ``REACH`` characters of an identifier, merged where they overlap, so that they are disjoint. Parts
are joined with the scopes that they overlap or touch, by an interval join on (row, block of positions): a part meets its
scopes, never another part. Weak parts of a scope become added spans only if it holds an identifier and a secret,
and either of them is a base span or an endpoint stands with them.

Defined cases: a null or empty text has no span; base spans of different kinds may overlap and all stay, an added span
overlaps none; of overlapping weak parts the first stays; repeated rows are judged each; empty tables give an empty
result; other columns are ignored. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ionweave.llm.common import materialize, quoted

#: Kinds and patterns of the contract. A run of at least so many signs from its start is what is left of the
#: contract's runs after those too short are dropped.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
LEAST_ASSIGN, LEAST_WEAK, REACH, STEP = 12, 6, 400, 64
#: Weak parts.
IDENTIFIER = r"""(?i:\b(?:user|username|login|account|client_?id|key_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+"""
SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9a-z+/_-]*+[A-Z])(?=[0-9A-Z+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i:\b(?:https?|ftp|jdbc:[a-z]+|postgres|postgresql|mysql|redis|mongodb|amqp))://[^\s"'<>]{4,}+"""
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")


def _spans(text: Column, pattern: str, matches: Column) -> Column:
    """(start, end) of each match in order: the pieces between matches have the lengths that ``split`` leaves.

    Sums run over steps of STEP matches and over whole steps, so that many matches in a text don't cost their square.
    """
    pieces = F.split(text, F.lit(pattern), -1)
    both = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda s, m: F.struct(F.length(s).cast("long").alias("g"), F.length(m).cast("long").alias("m")))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x["g"] + x["m"])
    steps = F.floor((F.size(both) - 1) / STEP).cast("int")
    before = F.aggregate(
        F.sequence(F.lit(0), steps), F.array(F.lit(0).cast("long")),
        lambda s, k: F.concat(s, F.array(F.element_at(s, -1) + total(F.slice(both, k * STEP + 1, F.lit(STEP))))),
    )
    packed = F.struct(both.alias("both"), before.alias("before"))

    def place(p: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            k = F.floor(i / STEP).cast("int")
            start = F.get(p["before"], k) + total(F.slice(p["both"], k * STEP + 1, i % STEP)) + x["g"]
            return F.struct(start.alias("start"), (start + x["m"]).alias("end"))

        return F.transform(p["both"], one)

    # A one-element array binds the sums once for all matches.
    return F.when(F.size(matches) > 0, F.element_at(F.transform(F.array(packed), place), 1)).otherwise(F.array().cast("array<struct<start:long,end:long>>"))


def _tagged(spans: Column, kind: int, strong: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), F.lit(strong).alias("strong")))


def parts(docs: DataFrame, carried: str = "doc_id") -> DataFrame:
    """row, the column ``carried``, base spans and weak parts of each row. ``row`` tells rows apart once this is a written table."""
    df = docs.select(F.col(carried), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "secret": SECRET, "endpoint": ENDPOINT}
    for name, pattern in patterns.items():
        df = df.withColumn(f"m_{name}", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    df = df.withColumn("values", F.when(F.size("m_assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>")))
    for name, pattern in patterns.items():
        df = df.withColumn(name, _spans(F.col("text"), pattern, F.col(f"m_{name}")))
    sized = F.zip_with("assign", "values", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
    df = df.withColumn("sized", sized)
    of_size = lambda lo, hi: F.filter("sized", lambda s: (s["n"] >= lo) & (s["n"] < hi))
    base = F.array_sort(F.concat(_tagged(of_size(LEAST_ASSIGN, 1 << 30), 0, True), _tagged(F.col("access"), 1, True), _tagged(F.col("hex"), 2, True)))
    weak = F.array_sort(F.concat(_tagged(F.col("identifier"), 3, False), _tagged(of_size(LEAST_WEAK, LEAST_ASSIGN), 4, False), _tagged(F.col("secret"), 4, False), _tagged(F.col("endpoint"), 5, False)))
    return df.select(F.monotonically_increasing_id().alias("row"), carried, base.alias("base"), weak.alias("weak"))


def _is_identifier(kind: Column) -> Column:
    return kind.isin(1, 3)


def _is_secret(kind: Column) -> Column:
    return kind.isin(0, 2, 4)


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, added): the weak parts that complete a credential within their scope."""
    both = F.concat("base", "weak")
    some = found.where((F.size("weak") > 0) & F.exists(both, lambda p: _is_identifier(p["kind"])) & F.exists(both, lambda p: _is_secret(p["kind"])))
    part = some.select("row", F.explode(both).alias("p")).select("row", "p.*")
    # Weak parts that overlap a base span, or a weak part before them, are no candidates.
    by_start = Window.partitionBy("row").orderBy("start", F.desc("strong"), "kind", "end")
    # Frames that grow: one that shrinks would be gone through anew for each part.
    by_end = Window.partitionBy("row").orderBy(F.desc("start"), "strong", F.desc("kind"), F.desc("end"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (by_start, by_end))
    clear = F.coalesce(F.max("end").over(before) <= F.col("start"), F.lit(True)) & F.coalesce(F.min(F.when(F.col("strong"), F.col("start"))).over(after) >= F.col("end"), F.lit(True))
    part = part.withColumn("ok", F.col("strong") | clear).where("ok").drop("ok")
    near = part.where(_is_identifier(F.col("kind"))).select("row", F.greatest(F.col("start") - reach, F.lit(0)).alias("lo"), (F.col("end") + reach).alias("hi"))
    order = Window.partitionBy("row").orderBy("lo", "hi")
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    scopes = near.withColumn("fresh", fresh)
    scopes = scopes.withColumn("scope", F.sum(F.col("fresh").cast("int")).over(order)).groupBy("row", "scope").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    width = 2 * reach
    block = lambda c: F.floor(c / width)
    tiled = scopes.withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))))
    # A part and a scope may have several blocks in common: they are joined in the first.
    spread = part.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end")))))
    inside = spread.join(tiled, ["row", "block"]).where((F.col("end") >= F.col("lo")) & (F.col("start") <= F.col("hi")) & (F.col("block") == F.greatest(block(F.col("start")), block(F.col("lo")))))
    scope = Window.partitionBy("row", "scope")
    has = lambda c: F.max(c.cast("int")).over(scope) == 1
    kind = F.col("kind")
    whole = has(_is_identifier(kind)) & has(_is_secret(kind)) & (has(F.col("strong") & (kind < 3)) | has(kind == 5))
    chosen = inside.withColumn("whole", whole).where("whole and not strong")
    return chosen.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end", "strong")).alias("added"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, base counts and digest, all spans and how many were added, of each row of ``docs`` (doc_id, text)."""
    found = materialize(parts(docs.select(F.col("doc_id").cast("long"), "text")), "secrets")
    out = found.join(linked(found, reach), "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long,strong:boolean>>")))
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id", *(n(k).alias(f"n_{KINDS[k]}") for k in range(3)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


def _masked(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each of the sorted spans, or several that overlap, as one mark."""
    done = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        out = F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit(mark))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), out.alias("out"))

    return F.aggregate(spans, done, step, lambda s: F.concat(s["out"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))))


def redacted(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` with all secrets in ``text`` masked and ``n_chars``, where there is one, counted again.

    Only rows with weak parts, which others may complete, are joined; the rest is masked where it is read. Rows are told
    apart by a written number: null and repeated doc_ids and repeated rows are masked each; a null text stays null.
    """
    found = materialize(parts(docs.select(F.struct(*quoted(docs.columns)).alias("doc"), "text"), "doc"), "secrets")
    none = F.array().cast("array<struct<start:long,kind:int,end:long,strong:boolean>>")
    alone = found.where(F.size("weak") == 0).select("doc", "base")
    more = found.where(F.size("weak") > 0).join(linked(found, reach), "row", "left").select("doc", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("base"))
    text = F.when(F.size("base") > 0, _masked(F.col("doc.text"), F.col("base"), mark)).otherwise(F.col("doc.text"))
    out = alone.unionByName(more).withColumn("masked", text)
    value = {"text": F.col("masked"), "n_chars": F.when(F.size("base") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*((value[c] if c in value else F.col(f"doc.{q}")).alias(c) for c, q in zip(docs.columns, quoted(docs.columns))))
