"""PII: fixed forms as seeds, and bootstrapped contextual extraction of further identifiers.

Seeds are the e-mail addresses, IP addresses, card and phone numbers of fixed forms, and secrets: long runs of letters and digits that a
text assigns. What stands around them induces lexical patterns: the one, two and three units before (a unit is a word, or the part of
a word up to the value), one on each side, and for numbers the form of the value itself. Patterns and their values make a graph, in which
Spark scores both in turn: a pattern by the share of a kind among its values, a value by the patterns that hold it. A
pattern of SUPPORT and CONFIDENCE discovers candidates: number groups, address-like runs or keys that the fixed forms miss, and whose
shape suits the kind. Support is the number of different seeds, and the scores of the discovered values of at least CONFIDENCE, which
so bring in further patterns. Scores only rise; the rounds end when none does any more. Other tokens with digits count against a pattern; for a
form only its seeds count, and every other candidate against it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, checkpoint, column_test, fresh, marked, salted_join, table

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET, BASE = 4, 4
SUPPORT, CONFIDENCE, UNKNOWN, UNIT = 5, 0.9, 0.1, 64
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"""[=:]\x20{0,3}["']?([0-9A-Za-z_+/-]{32,}+)(?![0-9A-Za-z])""")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20().:/-]{0,3}[0-9])++(?![0-9A-Za-z])")
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)*+")
_KEY = re.compile(r"(?<![0-9A-Za-z_+/-])[0-9A-Za-z_+/-]{8,}+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        last = found.end() if found else at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed forms, sorted; positions are code points."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out)


def _mixed(value: str) -> bool:
    """Whether a run holds letters and digits, as keys do and words or numbers don't."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def secret_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, SECRET, end) of the assigned keys: 32 or more letters and digits after an equals sign or a colon."""
    return [(m.start(1), SECRET, m.end(1)) for m in _SECRET.finditer(text) if _mixed(m[1])]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def _suits(value: str) -> int:
    """Bits of the kinds whose shape a candidate has."""
    if "@" in value or "(at)" in value or "[at]" in value:
        return 1
    groups = re.findall("[0-9]+", value)
    n = sum(map(len, groups))
    four = len(groups) == 4 and "." in value and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    return 2 * four | 4 * (13 <= n <= 19) | 8 * (7 <= n <= 15)


def _between(taken: list[tuple[int, int]], end: int) -> Iterator[tuple[int, int]]:
    """The gaps that sorted spans leave in a text."""
    at = 0
    for a, b in taken:
        if a > at:
            yield at, a
        at = max(at, b)
    if end > at:
        yield at, end


def _occurrences(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, kind or -1, shapes), sorted: seeds, candidates that overlap none, and (no shape) other tokens with digits."""
    out = [(a, b, k, 0) for a, k, b in seeds]
    taken = sorted((a, b) for a, b, _, _ in out)
    for pattern, shape in ((_ADDRESS, _suits), (_NUMBER, _suits), (_KEY, lambda x: (1 << SECRET) * _mixed(x)), (_TOKEN, lambda x: 0)):
        found = []
        for left, right in _between(taken, len(text)):
            for m in pattern.finditer(text, left, right):
                bits = shape(m[0])
                if bits or pattern is _TOKEN:
                    found.append((*m.span(), -1, bits))
        out += found
        taken = sorted([*taken, *((a, b) for a, b, _, _ in found)])
    return sorted(out)


def _unit(x: str) -> str:
    """A unit of a pattern: lower case, digits as 0; a long one by its digest, so that none is cut."""
    x = re.sub("[0-9]", "0", x.lower())
    return x if len(x) <= UNIT else hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _patterns(text: str, spans: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, str]]:
    """(place in spans, pattern) of sorted spans. A unit ends at the span before, so that the work grows with the text."""
    words = [m.span() for m in _WORD.finditer(text)]
    begins = [a for a, _ in words]
    ends = [0]  # the furthest end of the spans before each
    for _, b, _, _ in spans:
        ends.append(max(ends[-1], b))
    for i, (a, b, kind, shape) in enumerate(spans):
        at = bisect_right(begins, a) - 1
        units = []
        if (glued := text[max(words[at][0], min(ends[i], a)) : a]):
            units.append(_unit(glued))
        units += [_unit(text[x:y]) for x, y in reversed(words[max(0, at - 3 + len(units)) : at])]
        if units:
            last = bisect_right(begins, b - 1) - 1
            limit = spans[i + 1][0] if i + 1 < len(spans) else len(text)
            after = text[b : max(b, min(words[last][1], limit))] or (text[slice(*words[last + 1])] if last + 1 < len(words) else "")
            yield from ((i, " ".join(units[n::-1]) + " *") for n in range(len(units)))
            yield i, f"{units[0]} * {_unit(after)}"
        if kind in (1, 2, 3) or (kind < 0 and 1 < shape < 1 << SECRET):
            yield i, FORM + re.sub("[0-9]", "0", text[a:b])


FORM = "form "
_SPANS = "array<struct<start:int,k:int,end:int>>"
_READ = f"doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, base string, secrets {_SPANS}, pattern string, value string, kind int, shape int, start int, end int"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text with its seeds, and a row per pattern of each occurrence."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64()] * 6 + [pa.string(), span] + [pa.string()] * 2 + [pa.int32()] * 4
    names = [x.split()[0] for x in _READ.replace(_SPANS, "x").split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        texts = batch.column("text")
        rows: list[tuple] = []
        for i, (doc, h) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), strict=True)):
            text = texts[i].as_py()
            base, secret = base_spans(text), secret_spans(text)
            count = [sum(1 for _, k, _ in base if k == kind) for kind in range(BASE)]
            rows.append((doc, h, *count, joined(base), [{"start": a, "k": k, "end": b} for a, k, b in secret] or None, *[None] * 6))
            spans = _occurrences(text, [*base, *secret])
            for at, pattern in _patterns(text, spans):
                a, b, kind, shape = spans[at]
                rows.append((doc, h, *[None] * 6, pattern, _unit_value(text[a:b]), kind, shape, a, b))
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)
    T.tidy()


def _unit_value(x: str) -> str:
    """A value of the graph: lower case, a long one by its digest."""
    x = x.lower()
    return x if len(x) <= UNIT else hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _bootstrap(rows: DataFrame) -> DataFrame:
    """(pattern, k, confidence) of the patterns of high confidence, from the graph of patterns and values."""
    edges = rows.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("shape").alias("shape"))
    known = edges.groupBy("value").agg(F.max("kind").alias("kind"), F.max("shape").alias("shape"))
    # only patterns that have enough seeds and candidates, were all these of one kind, can ever be confident
    able = F.count_if((F.col("kind") >= 0) | (F.col("shape") > 0))
    strong = edges.groupBy("pattern").agg(able.alias("able"), F.count("*").alias("n")).where((F.col("able") >= SUPPORT) & (F.col("able") >= CONFIDENCE * F.col("n"))).select("pattern")
    edges = salted_join(salted_join(edges.select("pattern", "value"), strong, "pattern", "value"), known, "value", "pattern")
    edges = checkpoint(edges.withColumn("open", (F.col("kind") < 0) & (F.col("shape") > 0)).withColumn("light", F.col("open") & ~F.startswith("pattern", F.lit(FORM))))
    whole = checkpoint(edges.groupBy("pattern").agg(F.sum(F.when(F.col("light"), UNKNOWN).otherwise(1.0)).alias("whole")))
    seeds = edges.where("kind >= 0").select("value", F.col("kind").alias("k"), F.lit(1.0).alias("score")).distinct()
    score, last = seeds, 0
    while True:
        support = F.sum(F.when(~F.col("open") | (F.col("score") >= CONFIDENCE), F.col("score")).otherwise(0.0))
        more = F.sum(F.when(F.col("light"), F.greatest(F.col("score") - UNKNOWN, F.lit(0.0))).otherwise(0.0))
        # a form counts its seeds alone: to be of a common form proves nothing of a discovered value
        counted = edges.where("light or not open").select("pattern", "value", "open", "light")
        best = salted_join(counted, score, "value", "pattern").groupBy("pattern", "k").agg(F.sum("score").alias("own"), more.alias("more"), support.alias("support"))
        best = best.join(whole, "pattern").select("pattern", "k", "support", (F.col("own") / (F.col("whole") + F.col("more"))).alias("confidence"))
        best = checkpoint(best.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).drop("support"))
        held = salted_join(edges.where("open").select("pattern", "value", "shape"), best, "pattern", "value").where(F.expr("shape & shiftleft(1, k)") > 0)
        raised = checkpoint(held.groupBy("value", "k").agg((1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score")))
        total = best.select(F.col("confidence").alias("x")).union(raised.select("score")).agg(F.sum(F.round(F.col("x") * 10_000).cast("long"))).first()[0] or 0
        if total <= last:
            break
        score, last = seeds.union(raised), total
    return best.groupBy("pattern").agg(F.max_by("k", F.struct("confidence", -F.col("k"))).alias("k"), F.max("confidence").alias("confidence"))


def _added(rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, text_hash, added): the candidates that confident patterns of a suiting kind surround."""
    open_ = salted_join(rows.where("kind < 0 and shape > 0"), patterns.withColumn("at", F.lit(0)), "pattern", "value").where(F.expr("shape & shiftleft(1, k)") > 0)
    one = open_.groupBy("doc_id", "text_hash", "start", "end").agg(F.max_by("k", F.struct("confidence", -F.col("k"))).alias("k"))
    return one.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end"))).alias("added"))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, added) for every row of docs (doc_id, text).

    base has the fixed forms of the first four kinds as kind:start:end, comma-joined, in code points with the end exclusive; added the secrets and
    the discovered array<struct<start, k, end>>, k a place in KINDS, or null. A null text is empty and has none. Repeated rows give
    repeated results; a null doc_id is one like others. Other columns are not read. No rows: none.
    """
    bounded_batches(docs.sparkSession)
    read = checkpoint(_texts(docs).mapInArrow(_read, _READ))
    rows = read.where("pattern is not null").drop("secrets")
    added = _added(rows, _bootstrap(rows)).select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), "added")
    found = read.where("pattern is null").join(added, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("text_hash") == F.col("hash")), "left")
    none = F.expr(f"cast(array() as {_SPANS})")
    every = F.array_sort(F.concat(F.coalesce("secrets", none), F.coalesce("added", none)))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", F.when(F.size(every) > 0, every).alias("added"))


def masked_text(text: str, more: list[tuple[int, int, int]]) -> str:
    """The text with its fixed forms, secrets and the spans `more` as their kinds; overlapping ones are one, named by the first."""
    parts, last = [], 0
    for a, k, b in sorted([*base_spans(text), *secret_spans(text), *more]):
        if a >= last:
            parts += [text[last:a], f"<{KINDS[k].upper()}>"]
        last = max(last, b)
    return "".join(parts) + text[last:]


def mask(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind in angle brackets and n_chars, if there, counted anew.

    Overlapping spans are replaced as one, named by the first. All rows and columns stay, whatever their names; a null text stays null.
    """
    bounded_batches(docs.sparkSession)
    read = checkpoint(_texts(docs).mapInArrow(_read, _READ))
    rows = read.where("pattern is not null").drop("secrets")
    added = checkpoint(_added(rows, _bootstrap(rows)))
    names, schema = docs.columns, docs.schema
    doc, content, other_doc, other_content, more, key = fresh(docs, "doc_key", "text_key", "other_doc_key", "other_text_key", "more_spans", "marked_key")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if key in batch.schema.names:
                hit = held(batch.column(key).to_numpy(zero_copy_only=False)) & batch.column("text").is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(~hit))
            texts = batch.column("text").to_pylist()
            extra = batch.column(more).to_pylist() if more in batch.schema.names else [None] * len(texts)
            changed = {}
            for i, (text, found) in enumerate(zip(texts, extra, strict=True)):
                if text:
                    new = masked_text(text, [(x["start"], x["k"], x["end"]) for x in found or []])
                    if new != text:
                        changed[i] = new
            out = pa.array([changed.get(i, x) for i, x in enumerate(texts)], batch.column("text").type)
            columns = [out if c == "text" else batch.column(c) for c in names]
            if changed and "n_chars" in names:
                counts = batch.column("n_chars").to_pylist()
                columns[names.index("n_chars")] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(counts)], batch.column("n_chars").type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        T.tidy()

    number = F.xxhash64(F.col("doc_id").cast("long"))
    held = marked(added.select(number.alias("key")))
    # texts without discovered spans stay where they are; the few others meet theirs
    plain = docs.withColumn(key, number).mapInArrow(masked, schema)
    rest = docs.where(F.col("text").isNotNull() & column_test(held)(number))
    rest = rest.withColumns({doc: F.col("doc_id").cast("long"), content: F.xxhash64(F.col("text").cast("string"))})
    more_of = added.select(F.col("doc_id").alias(other_doc), F.col("text_hash").alias(other_content), F.col("added").alias(more))
    # never a broadcast join: a task would run the test and the masking in two Python workers at once, and workers stay
    rest = rest.join(more_of.hint("merge"), F.col(doc).eqNullSafe(F.col(other_doc)) & (F.col(content) == F.col(other_content)), "left")
    return plain.union(rest.select(*names, more).mapInArrow(masked, schema))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda x: F.concat_ws(":", F.element_at(kinds, x["k"] + 1), x["start"], x["end"])
    # base and added spans in one list, sorted by start and then kind
    parsed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(
        F.split(x, ":")[1].cast("int").alias("start"), (F.array_position(kinds, F.split(x, ":")[0]) - 1).cast("int").alias("k"), F.split(x, ":")[2].cast("int").alias("end")))
    every = F.array_sort(F.concat(parsed, F.coalesce("added", F.expr(f"cast(array() as {_SPANS})"))))
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_join(F.transform(every, named), ","))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
