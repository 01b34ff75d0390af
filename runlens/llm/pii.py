"""Personal data: patterns, and a character model for what they miss.

Base spans (e-mail, IP address, card, phone) come from patterns with checks. The
model, a bidirectional LSTM with a CRF, is trained on spans labelled in the
corpus: in a bounded sample of windows, at most ``SAMPLE`` per kind in seeded
hash order, the base spans are the labels; each window is also learned in a
variant in which its spans are written in ways the patterns don't accept (other
separators, no country code, spaces around the @), and windows with digits but no
span are learned as they are. The model adds spans that overlap no base span,
whose every character it is sure of (``SURE``), that are not part of a longer
word or number, and whose digits pass the checks of their kind.

Texts are read in windows of ``WINDOW`` characters that overlap by half. All
labelled spans, variants included, have a digit or an @; windows without either
hold nothing that can start or carry a label and are not run. In overlapping
windows a character takes the scores of the window in whose middle it lies, and
each stretch of windows is decoded as one sequence, so no span is cut at an edge.

Defined results: null texts are empty and have no spans; base spans of different
kinds may overlap; added spans overlap nothing; without any labelled span in the
sample nothing is added; ties in hash order are broken by the window's text;
an empty table gives no rows; input columns named ``pii_spans`` are replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

from runlens.llm.common import column, free, ship, slices, without
from runlens.llm.crf import Tagger
from runlens.llm.mixing import seeded_order

KINDS = ("email", "ip", "card", "phone")
WINDOW = 96
#: Windows per kind (and without a span) that are learned from.
SAMPLE = 300
#: Least probability of every character of an added span.
SURE = 0.9
#: Windows that are run together.
BATCH = 512

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match that fails from the first digit of a run fails from the others too
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """The base spans by start, then kind."""
    out: list[Span] = []
    if not text or not _TRIGGER.search(text):
        return out
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_MARKS = " \n.,;:@+-()[]_%=\"'/#"


@lru_cache(1)
def _symbol_table() -> np.ndarray:
    """Symbols of the model: 0 padding, letters, a digit, marks, other letters, the rest."""
    table = np.empty(0x110000, np.uint8)
    table[:] = 2
    for code in range(0x3000):
        c = chr(code)
        if "a" <= c.lower() <= "z" and len(c.lower()) == 1:
            table[code] = 10 + ord(c.lower()) - ord("a")
        elif "0" <= c <= "9":
            table[code] = 3
        elif c in _MARKS:
            table[code] = 40 + _MARKS.index(c)
        elif unicodedata.category(c)[0] == "L":
            table[code] = 1
    return table


SYMBOLS, LABELS = 64, 1 + 2 * len(KINDS)


def encode(text: str) -> np.ndarray:
    return _symbol_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def _variant(kind: int, span: str, rng: np.random.Generator) -> str:
    """The same data, written as the patterns don't accept."""
    digits = re.sub(r"[^0-9]", "", span)
    if kind == 0:
        return span.replace("@", str(rng.choice([" @ ", "@ ", " @"])))
    if kind == 1:
        return span.replace(".", str(rng.choice([" . ", ". "])))
    if kind == 2:
        return str(rng.choice([". ", ".", " - "])).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    return str(rng.choice([f"({last[:3]}) {last[3:6]}-{last[6:]}", f"{last[:3]}-{last[3:6]}-{last[6:]}", f"{last[:3]}.{last[3:6]}.{last[6:]}"]))


def _examples(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of a window's text, padded."""
    code, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
    symbols = encode(text)[:WINDOW]
    code[:len(symbols)] = symbols
    for start, kind, end in spans:
        if start < WINDOW:
            tags[start:min(end, WINDOW)] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return code, tags


def _rewritten(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    out, moved, at = "", [], 0
    for start, kind, end in spans:
        out += text[at:start]
        new = _variant(kind, text[start:end], rng)
        moved.append((len(out), kind, len(out) + len(new)))
        out, at = out + new, end
    return out + text[at:], moved


def learn(windows: list[tuple[str, list[Span]]], seed: int = 5, steps: int = 400) -> Tagger | None:
    """A tagger from windows with non-overlapping labelled spans; None without a span."""
    if not any(spans for _, spans in windows):
        return None
    rng, rows = np.random.default_rng(seed), []
    for text, spans in windows:
        rows.append(_examples(text, spans, rng))
        if spans:
            rows.append(_examples(*_rewritten(text, spans, rng), rng))
    tagger = Tagger(SYMBOLS, LABELS)
    tagger.fit(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), steps)
    return tagger


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][2]:
            out.append(s)
    return out


def stretches(text: str) -> list[tuple[int, int]]:
    """Runs of overlapping windows that have a digit or an @."""
    half, out = WINDOW // 2, []
    for k in sorted({j for m in _TRIGGER.finditer(text) for j in (m.start() // half - 1, m.start() // half) if j >= 0}):
        start, end = k * half, min(k * half + WINDOW, len(text))
        if out and start <= out[-1][1] - half:  # the window before it holds its first half
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        elif start < len(text):
            out.append((start, end))
    return out


def plausible(text: str, span: Span) -> bool:
    """Whether a span of the model stands alone and has what its kind needs."""
    start, kind, end = span
    if text[start - 1:start].isalnum() or text[end:end + 1].isalnum():
        return False
    inner = text[start:end]
    numbers = re.findall("[0-9]+", inner)
    digits = "".join(numbers)
    if kind == 0:
        return "." in inner.partition("@")[2]
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans that the model is sure of, per text."""
    found: list[list[Span]] = [[] for _ in texts]
    half = WINDOW // 2
    runs = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    runs.sort(key=lambda r: r[2] - r[1])
    # runs of like length together; a window number of characters at a time bounds memory
    at = 0
    while at < len(runs):
        take, most = [], 0
        while at < len(runs) and (not take or (len(take) + 1) * (runs[at][2] - runs[at][1]) <= BATCH * WINDOW):
            take.append(runs[at])
            most = max(most, runs[at][2] - runs[at][1])
            at += 1
        scores = np.zeros((len(take), most, LABELS))
        codes, place = [], []
        for r, (i, a, b) in enumerate(take):
            symbols = encode(texts[i][a:b])
            for w in range(0, max(len(symbols) - half, 1), half):
                code = np.zeros(WINDOW, np.int64)
                code[:len(symbols[w:w + WINDOW])] = symbols[w:w + WINDOW]
                codes.append(code)
                place.append((r, w, len(symbols)))
        for first in range(0, len(codes), BATCH):
            e = tagger.emissions(np.array(codes[first:first + BATCH]))
            for (r, w, n), own in zip(place[first:first + BATCH], e, strict=True):
                # the middle half is this window's; the ends too where no window overlaps
                a = 0 if w == 0 else half // 2
                b = WINDOW if w + WINDOW >= n else WINDOW - half // 2
                b = min(b, n - w)
                scores[r, w + a:w + b] = own[a:b]
        length = np.array([b - a for _, a, b in take])
        for (i, a, _), (tags, sure) in zip(take, tagger.decode(scores, length), strict=True):
            t = 0
            while t < len(tags):
                if tags[t] % 2 == 1:  # a span begins
                    end = t + 1
                    while end < len(tags) and tags[end] == tags[t] + 1:
                        end += 1
                    span = (a + t, (int(tags[t]) - 1) // 2, a + end)
                    if sure[t:end].min() >= SURE and plausible(texts[i], span):
                        found[i].append(span)
                    t = end
                else:
                    t += 1
    return found


def train(rows: DataFrame) -> Tagger | None:
    """Fit on rows (h, text) in one task; the sample and the model have fixed bounds."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, kind, text_, spans_ = [], [], [], []
            for key, text in zip(batch.column("h").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                hits = [m.start() for m in _TRIGGER.finditer(text or "")]
                spans = _disjoint(base_spans(text)) if hits else []
                lead = int(key[:8], 16) % (WINDOW // 2)  # spans lie anywhere in the first half
                done = -1
                for at in [s[0] for s in spans] + [x for x in hits if not any(a - WINDOW < x < b + WINDOW for a, _, b in spans)][:1]:
                    start = max(0, at - lead)
                    if start < done:
                        continue
                    done = start + WINDOW
                    part = [(a - start, k, b - start) for a, k, b in spans if a >= start and b <= start + WINDOW]
                    h.append(key)
                    kind.append(KINDS[part[0][1]] if part else "none")
                    text_.append(text[start:start + WINDOW])
                    spans_.append([x for p in part for x in p])
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(kind, pa.string()), pa.array(text_, pa.string()),
                                              pa.array(spans_, pa.list_(pa.int32()))], names=["h", "kind", "window", "spans"])

    found = rows.select("h", "text").mapInArrow(windows, "h string, kind string, window string, spans array<int>")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("h", "window"))
    picked = found.withColumn("place", place).where(F.col("place") <= SAMPLE).drop("place")  # at most SAMPLE per kind

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["h"], r["window"], r["kind"]))
        tagger = learn([(r["window"], [tuple(r["spans"][i:i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([tagger.to_bytes()] if tagger else [], pa.binary())], names=["model"])

    made = picked.repartition(1).mapInArrow(fit, "model binary").collect()
    return Tagger.from_bytes(bytes(made[0]["model"])) if made else None


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with ``pii_spans``: array of (kind, start, end, base), by start, then kind.

    Places are code points, the end is exclusive.
    """
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(seeded_order(column(docs, id_col), "pii").alias("h"), text.alias("text"))
    model = spark.sparkContext.broadcast(train(rows.where(F.col("text").rlike("[0-9@]"))))
    kept = docs.select(*[column(docs, c) for c in without(docs, ("pii_spans",))])
    # a string column is read where it is, so that no batch holds its texts twice
    plain_text = text_col in kept.columns and isinstance(kept.schema[text_col].dataType, StringType)
    held = text_col if plain_text else free(docs, "_text")
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(held).to_pylist()]
            base = [base_spans(t) for t in texts]
            extra = model_spans(texts, model.value) if model.value else [[] for _ in texts]
            spans = []
            for own, more in zip(base, extra, strict=True):
                more = [s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in own)]
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base}
                              for a, k, b, is_base in sorted([(*s, True) for s in own] + [(*s, False) for s in more])])
            plain = batch if plain_text else batch.drop_columns([held])
            yield pa.RecordBatch.from_arrays([*plain.columns, pa.array(spans, pa.list_(item))], names=[*plain.schema.names, "pii_spans"])

    span = StructType().add("kind", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("base", BooleanType())
    schema = StructType([*kept.schema.fields]).add("pii_spans", ArrayType(span))
    rows = kept if plain_text else kept.withColumn(held, text)
    return rows.mapInArrow(tag, schema)


def mask(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind; of overlapping spans the first stands."""
    n = F.length(text)
    walked = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"),
        )).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))))
    return F.when(F.size(spans) > 0, F.concat(walked["out"], text.substr(walked["at"] + 1, n))).otherwise(text)
