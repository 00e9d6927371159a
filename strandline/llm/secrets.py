"""Secret scans by multipart credential linking, with DataFrame functions only.

Strong parts (assigned secrets, access keys, long hex runs) stand by themselves. Weak candidates are parts that mean
little alone: random-looking words, account names, endpoints. A weak candidate is reported only when a complementary
part co-occurs within ``reach`` code points and in the same scope (no blank line between them):

* a random-looking word (``random``) beside an access key, an account or an endpoint,
* an account (``account``) or an endpoint (``endpoint``) beside a secret of any kind.

Parts leave the scan as rows, and so do the blank lines of texts with weak candidates. In order of place, running sums
give each part its scope, and tell which weak candidates a strong part overlaps (these are dropped). Weak ones are then
dealt to every cell of ``reach`` code points that their interval, widened by ``reach``, touches; parts to every cell that
they touch themselves, so that long ones meet what is near either end. The interval join is then an equi-join on
(document, cell) with a distance condition. A cell has room for few parts, so the number of pairs is bounded by the
text's length.

Defined results: null and empty texts have no spans; every row of the input gives one row, repeated ids included; other
columns are ignored; an empty table gives an empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, small, written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the runs are maximal, so a run that is too short holds no other match
HEX = r"[0-9a-f]{16,}"
RANDOM = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ACCOUNT = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
ENDPOINT = r"(?:https?|ftp|s3|jdbc|postgres|mysql|mongodb|redis|amqp)://[A-Za-z0-9.:/_%?=&@-]+"
BLANK_LINE = r"\n[\x20\t\r]*\n"
BASE, ADDED = ("assign", "access", "hex"), ("random", "account", "endpoint")
KINDS = BASE + ADDED
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": RANDOM, "account": ACCOUNT, "endpoint": ENDPOINT, "blank": BLANK_LINE}
REACH = 200
#: Matches that are added up one by one; longer lists are added up in pieces of as many.
PIECE = 256
SPAN = "struct<start:int,no:int,end:int>"


def _steps(found: str, pattern: str) -> Column:
    """Each match (of the column found) with the length of the text between it and the match before it."""
    gaps = F.slice(F.transform(F.split("text", pattern, -1), F.length), 1, F.size(found))
    return F.when(F.size(found) > 0, F.zip_with(F.col(found), gaps, lambda m, gap: F.struct(gap.alias("gap"), m.alias("value"))))


def _places(steps: str, no: int) -> Column:
    """Steps as an array of (start, no, end, value), by start. Pieces are added up first, so that a text with many matches isn't copied once a match."""
    span = "struct<start:int,no:int,end:int,value:string>"
    empty = lambda kind: F.array().cast(f"array<{kind}>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        one = F.struct(start.alias("start"), F.lit(no).alias("no"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def moved(by):
        return lambda s: F.struct((s["start"] + by).alias("start"), s["no"].alias("no"), (s["end"] + by).alias("end"), s["value"].alias("value"))

    first = lambda kind: F.struct(F.lit(0).alias("at"), empty(kind).alias("out"))
    pieces = F.transform(F.sequence(F.lit(0), F.size(steps) - 1, F.lit(PIECE)), lambda i: F.aggregate(F.slice(steps, i + 1, PIECE), first(span), step))
    add = lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(F.transform(p["out"], moved(acc["at"])))).alias("out"))
    whole = F.flatten(F.aggregate(pieces, first(f"array<{span}>"), add, lambda acc: acc["out"]))
    return F.when(F.col(steps).isNotNull(), whole).otherwise(empty(span))


def matches(rows: DataFrame, kinds) -> DataFrame:
    """rows (with text) and, for each kind, its leftmost non-overlapping matches: an array of (start, no, end, value), by start."""
    kept = rows.columns
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias(f"found_{k}") for k in kinds))
    rows = rows.select(*kept, *(_steps(f"found_{k}", PATTERNS[k]).alias(f"steps_{k}") for k in kinds))
    return rows.select(*kept, *(_places(f"steps_{k}", KINDS.index(k) if k in KINDS else -1).alias(k) for k in kinds))


def label(spans: Column | str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["no"]), s["start"], s["end"])), ",")


def parts(docs: DataFrame) -> DataFrame:
    """Each row of docs without its text: ids, counts, its strong spans (base), its weak candidates, and, where it has
    some, its blank lines (no -1, start and end where the line ends)."""
    rows = matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash")), KINDS)
    slim = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["no"].alias("no"), s["end"].alias("end")))
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
    long = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12)
    rows = rows.select("doc_id", "text", "text_hash", slim(long).alias("assign"), slim("access").alias("access"), slim("hex").alias("hex"), slim(F.concat(F.filter("random", mixed), "account", "endpoint")).alias("weak"))
    rows = matches(rows.withColumn("text", F.when(F.size("weak") > 0, F.col("text")).otherwise("")), ("blank",))
    blank = F.transform("blank", lambda s: F.struct(s["end"].alias("start"), s["no"].alias("no"), s["end"].alias("end")))
    counts = (F.size(k).cast("long").alias(f"n_{k}") for k in BASE)
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", *counts, F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "weak", blank.alias("blank"))


def _scoped(table: DataFrame) -> DataFrame:
    """(row, start, no, end, scope) of the parts of rows with weak candidates; weak ones that a strong part overlaps are left out."""
    rows = table.where(F.size("weak") > 0).select("row", F.explode(F.concat("base", "weak", "blank")).alias("s")).select("row", "s.*")
    strong = F.col("no").between(0, len(BASE) - 1)
    ahead = Window.partitionBy("row").orderBy("start", "no").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("no")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("scope", F.sum((F.col("no") < 0).cast("int")).over(ahead)).withColumn("covered", F.max(F.when(strong, F.col("end"))).over(ahead))
    rows = rows.withColumn("next", F.min(F.when(strong, F.col("start"))).over(back))
    overlapped = F.coalesce(F.col("covered") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return rows.where((F.col("no") >= 0) & (strong | ~overlapped)).select("row", "start", "no", "end", "scope")


def scan_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, text_hash, n_assign, n_access, n_hex, base and spans (arrays of start, no, end; no indexes KINDS) of every row."""
    table = written(parts(docs), "secret-parts")
    scoped = _scoped(table)
    cell = lambda c: F.floor(c / reach)
    near = scoped.where(F.col("no") >= len(BASE)).withColumn("cell", F.explode(F.sequence(cell(F.col("start") - reach), cell(F.col("end") + reach))))
    other = scoped.select("row", F.col("start").alias("b_start"), F.col("no").alias("b_no"), F.col("end").alias("b_end"), F.col("scope").alias("b_scope"), F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
    kind = lambda c, *names: c.isin([KINDS.index(n) for n in names])
    a, b = F.col("no"), F.col("b_no")
    fits = (kind(a, "random") & kind(b, "access", "account", "endpoint")) | (kind(a, "account", "endpoint") & kind(b, "assign", "hex", "random"))
    apart = F.greatest(F.col("b_start") - F.col("end"), F.col("start") - F.col("b_end"))
    linked = near.join(other, ["row", "cell"]).where(fits & (F.col("scope") == F.col("b_scope")) & (apart <= reach))
    linked = linked.groupBy("row").agg(F.collect_set(F.struct("start", "no", "end")).alias("linked"))
    out = table.join(linked, "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>"))))
    return out.select("doc_id", "text_hash", "n_assign", "n_access", "n_hex", "base", spans.alias("spans"))


def redact(docs: DataFrame, reach: int = REACH, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mask (spans that overlap or touch count as one), all columns kept. Texts are masked where they are read; only spans are joined to them."""
    own_id, own_hash, own_spans = (free_name(docs.columns, x) for x in ("secret_id", "secret_hash", "secret_spans"))
    found = scan_secrets(docs, reach).where(F.size("spans") > 0)
    found = found.groupBy(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).agg(F.first("spans").alias(own_spans))  # equal texts have equal spans
    found = small(written(found, "secret-spans"), F.size(own_spans) * 40 + 64)
    rows = docs.join(found, docs["doc_id"].eqNullSafe(found[own_id]) & (F.xxhash64(docs["text"]) == found[own_hash]), "left")

    def step(acc, s):
        fresh = s["start"] > acc["at"]
        gap = F.substring(docs["text"], acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh | (acc["out"] == ""), F.concat(acc["out"], F.when(fresh, gap).otherwise(F.lit("")), F.lit(mask))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(own_spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(docs["text"], acc["at"] + 1, F.length(docs["text"]))))
    text = F.when(F.col(own_spans).isNull(), docs["text"]).otherwise(done)
    changed = {"text": text, "n_chars": F.when(F.col(own_spans).isNull(), docs["n_chars"]).otherwise(F.length(text).cast("long")) if "n_chars" in docs.columns else None}
    return rows.select(*(changed[c].alias(c) if changed.get(c) is not None else docs[c] for c in docs.columns))
