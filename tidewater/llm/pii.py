"""Personal data spans: fixed patterns, and a semi-Markov conditional random field over whole candidate spans.

The field scores a segment of up to LONGEST tokens as one entity by features of the whole span (digit count, check sum,
shape, what adjoins it) and a dynamic programme picks boundaries and types together. It is trained here, on windows of
the corpus that the fixed patterns label and on altered copies of them that the patterns no longer match.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_spread

KINDS = ("email", "ip", "card", "phone")
LONGEST = 15
#: Windows learned from at most: as many of each kind, and twice as many with nothing in them.
TRAIN_WINDOWS, EPOCHS = 280, 4
WINDOW, MARGIN = 160, 12

# possessive forms of the contract's patterns: a run that fails is passed once, so long runs take linear time
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.DOTALL)
#: What announces a telephone number, right before it.
_CUE = re.compile(r"\b(?:call|tel|phone|fax|mobile|cell|dial|ring|telefon|handy|tél|téléphone|teléfono|móvil)[.:]?\s+$", re.IGNORECASE)
CUE_REACH = 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digit(c: str) -> bool:
    """One of 0 to 9: raised, circled and other scripts' digits are no numbers here."""
    return "0" <= c <= "9"


def _digits(s: str) -> str:
    return "".join(filter(_digit, s))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, leftmost and non-overlapping for each kind, in code points."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p) < 10 and int(p) <= 255 or int(p[-10:]) <= 255 and not p[:-10].strip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) < 60 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the field ---------------------------------------------------------------------------------------------------

FEATURES = (
    "bias one_at at_local at_domain_dot at_space digits_1_8 digits_9_11 digits_12_15 digits_16_19 digits_20 dots_3 parts_255 "
    "luhn plus brackets phone_marks digits_only letters digit_ends letter_end open_left open_right tokens_1 tokens_2_5 tokens_6 spaces letters_digits "
    "cue zero_first"
).split()


@lru_cache(maxsize=10_000)
def _span_features(s: str, before: str, after: str, tokens: int, cue: bool) -> tuple[int, ...]:
    """Indices of the features that hold for a whole span after one character and before up to two, announced or not."""
    digits = _digits(s)
    n = len(digits)
    letters = any(c.isalpha() for c in s)
    local, _, domain = s.partition("@")
    dotted = re.split(r"\[?\.\]?", s)
    numbers = len(dotted) == 4 and all(p.isascii() and p.isdigit() for p in dotted)
    marks = not letters and all(c in " +().-0123456789" for c in s)
    on = (
        True,
        s.count("@") == 1,
        s.count("@") == 1 and bool(local) and all(_LOCAL.match(c) for c in local),
        s.count("@") == 1 and bool(re.fullmatch(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain)),
        "@" in s and any(c.isspace() for c in s),
        1 <= n <= 8,
        9 <= n <= 11,
        12 <= n <= 15,
        16 <= n <= 19,
        n >= 20,
        numbers,
        numbers and all(len(p) < 4 and int(p) < 256 for p in dotted),
        12 <= n <= 19 and not letters and luhn(digits),
        s[0] == "+",
        "(" in s and ")" in s,
        marks and any(c in "()-. " for c in s),
        not letters and all(c in " -0123456789" for c in s),
        letters,
        _digit(s[0]) and _digit(s[-1]),
        s[-1].isalpha(),
        before.isalnum() or before in tuple("@._+-"),
        after[0].isalnum() or after[0] in "@_-" or after[0] == "." and after[1:].isalnum(),
        tokens == 1,
        2 <= tokens <= 5,
        tokens >= 6,
        any(c.isspace() for c in s),
        letters and n > 0,
        cue and not letters,
        not letters and digits.startswith("0"),
    )
    return tuple(i for i, x in enumerate(on) if x)


def _segments(text: str, start: int, end: int):
    """Of each token of a window its bounds and the candidate segments that end there: (first token, features)."""
    last: deque[tuple[int, bool, bool, bool]] = deque(maxlen=LONGEST)  # start, solid, marked, announced
    for j, m in enumerate(_TOKEN.finditer(text, start, end)):
        a, e = m.span()
        number = _digit(text[a]) or text[a] in "+("
        last.append((a, not text[a].isspace(), _digit(text[a]) or text[a] == "@", number and bool(_CUE.search(text[max(0, a - CUE_REACH) : a]))))
        own = []
        if last[-1][1]:
            first = j + 1 - len(last)
            marked = max((n for n, x in enumerate(last) if x[2]), default=-1)
            for n in range(marked + 1):
                x, solid, _, cue = last[n]
                if solid and (text[x].isalnum() or text[x] in "+("):
                    own.append((first + n, _span_features(text[x:e], text[x - 1 : x] if x else " ", text[e : e + 2] or " ", len(last) - n, cue)))
        yield a, e, own


def _lattice(text: str, start: int, end: int):
    """Token bounds of a window, and its candidate segments by end token."""
    found = list(_segments(text, start, end))
    return [(a, e) for a, e, _ in found], [own for _, _, own in found]


def _segment_scores(by_end, weights: np.ndarray):
    return [[(i, weights[:, list(f)].sum(axis=1), f) for i, f in own] for own in by_end]


def decode(text: str, start: int, end: int, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """Best-scoring choice of entities in a window: (start, kind, end); tokens outside entities score 0. One pass over a
    window of any length, which keeps some 33 bytes a token."""
    starts, ends, best, back, kinds = array("q"), array("q"), array("d", [0.0]), array("q", [-1]), array("b", [0])
    for a, e, own in _segments(text, start, end):
        starts.append(a)
        ends.append(e)
        top, how = best[-1], (-1, 0)
        for i, s, _ in _segment_scores([own], weights)[0]:
            k = int(s.argmax())
            if best[i] + s[k] > top:
                top, how = best[i] + float(s[k]), (i, k)
        best.append(top)
        back.append(how[0])
        kinds.append(how[1])
    out, j = [], len(starts)
    while j:
        i = back[j]
        if i >= 0:
            out.append((starts[i], kinds[j], ends[j - 1]))
            j = i
        else:
            j -= 1
    return out[::-1]


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and at signs, out to the blanks on either side, near ones joined."""
    a = b = -1
    for m in _MARK.finditer(text):
        if m.start() < b:
            continue
        x, y = m.start(), m.end()
        while x > max(0, b) and not text[x - 1].isspace():
            x -= 1
        while y < len(text) and not text[y].isspace():
            y += 1
        if a >= 0 and x - b <= 1:
            b = y
        else:
            if a >= 0:
                yield a, b
            a, b = x, y
    if a >= 0:
        yield a, b


def ascent(tokens, by_end, gold: list[tuple[int, int, int]], w: np.ndarray) -> tuple[float, np.ndarray]:
    """(log likelihood, its gradient by weights) of the labelled entities of one window.

    Expected feature counts come from the segment lattice's forward and backward sums.
    """
    n = len(tokens)
    scored = _segment_scores(by_end, w)
    ahead = np.zeros(n + 1)
    for j in range(n):
        terms = [ahead[j], *(ahead[i] + x for i, s, _ in scored[j] for x in s)]
        m = max(terms)
        ahead[j + 1] = m + np.log(np.exp(np.array(terms) - m).sum())
    by_start: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
    for j, own in enumerate(scored):
        for i, s, _ in own:
            by_start[i].append((j, s))
    behind = np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        terms = [behind[i + 1], *(behind[j + 1] + x for j, s in by_start[i] for x in s)]
        m = max(terms)
        behind[i] = m + np.log(np.exp(np.array(terms) - m).sum())
    truth = {(a, e): k for a, k, e in gold}
    likelihood, change = -ahead[n], np.zeros_like(w)
    for j, own in enumerate(scored):
        for i, s, f in own:
            p = -np.exp(np.minimum(0, ahead[i] + s + behind[j + 1] - ahead[n]))
            k = truth.get((tokens[i][0], tokens[j][1]))
            if k is not None:
                likelihood += s[k]
                p[k] += 1
            change[:, list(f)] += p[:, None]
    return float(likelihood), change


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-3) -> np.ndarray:
    """Weights (kind, feature) that raise the likelihood of the labelled windows, by stochastic gradient ascent."""
    w = np.zeros((len(KINDS), len(FEATURES)))
    lattices = [(*_lattice(t, 0, len(t)), y) for t, y in samples]
    for epoch in range(epochs):
        step = rate / (1 + 0.3 * epoch)
        for tokens, by_end, gold in lattices:
            w += step * np.clip(ascent(tokens, by_end, gold, w)[1], -2, 2) - step * decay * w
    return w


def altered(text: str, span: tuple[int, int, int]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled windows made of one with one fixed span: forms that the fixed patterns miss, and near ones that are none."""
    a, k, e = span
    s, kind = text[a:e], KINDS[k]
    digits = _digits(s)
    out = []

    def put(new: str, labelled: bool = True, cue: str = "") -> None:
        at = a + len(cue)
        out.append((text[:a] + cue + new + text[e:], [(at, k, at + len(new))] if labelled else []))

    if kind == "card" and s == digits:
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        for x in (digits, wrong):
            put(".".join(x[i : i + 4] for i in range(0, len(x), 4)), x == digits)
        put(wrong, False)
    elif kind == "ip":
        put(s.replace(".", "[.]"))
        put(".".join(["700", *s.split(".")[1:]]), False)
    elif kind == "email":
        put(s[: s.index("@")] + "@" + s[s.index("@") + 1 :].split(".")[0], False)
    elif kind == "phone":
        local = f"0{digits[-10:-7]} {digits[-7:]}"
        if "(" in s:
            put(s[s.index("(") :])
        put(f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:]}")
        put(local, True, "Tel. " if int(digits[-1]) % 2 else "call ")
        put(local, False)
    return out


def labelled_windows(text: str) -> Iterator[tuple[int, str, list[tuple[int, int, int]]]]:
    """(kind of the first fixed span or -1, window, its fixed spans) of the short windows of a text in which no fixed
    spans overlap."""
    spans = base_spans(text)
    for a, b in windows(text):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        own = [(x - a, k, y - a) for x, k, y in spans if a <= x and y <= b]
        if b - a <= WINDOW and all(own[i][2] <= own[i + 1][0] for i in range(len(own) - 1)):
            yield own[0][1] if own else -1, text[a:b], own


def sample_windows(docs: DataFrame, text_col: str, each: int) -> list[tuple[int, str]]:
    """Of all windows of all texts the `each` with the least hashes of each kind, twice as many of those with no span:
    tasks keep their own least ones, so the driver sees a bounded few whatever the corpus, the same ones however cut."""
    most = {k: each * (1 + (k < 0)) for k in range(-1, len(KINDS))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[int, str]] = {k: {} for k in range(-1, len(KINDS))}
        for b in batches:
            for t in b.column(0):
                text = t.as_py()
                if text and _MARK.search(text):
                    for kind, window, _ in labelled_windows(text):
                        least[kind][xxhash.xxh3_64_intdigest(window.encode("utf-8", "surrogatepass")) >> 1] = window
            for kind, own in least.items():
                if len(own) > most[kind]:
                    least[kind] = {h: own[h] for h in sorted(own)[: most[kind]]}
        rows = [(k, h, w) for k, own in least.items() for h, w in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kind", "h", "window"])

    rows = checkpoint(docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind int, h long, window string").distinct())
    return [(k, r["window"]) for k in sorted(most) for r in rows.where(F.col("kind") == k).orderBy("h").limit(most[k]).collect()]


def learned_from(windows_: list[str]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows labelled by the fixed patterns, and the altered copies of those with one span."""
    samples = [(w, own) for w in windows_ for own in [base_spans(w)] if all(own[i][2] <= own[i + 1][0] for i in range(len(own) - 1))]
    return samples + [x for t, own in samples if len(own) == 1 for x in altered(t, own[0])]


def fit(docs: DataFrame, text_col: str = "text", train_windows: int = TRAIN_WINDOWS) -> np.ndarray:
    """Trains on a bounded sample, about train_windows in all: the windows with the least hashes in the corpus, and
    altered copies of those that can be altered."""
    samples = learned_from([w for _, w in sample_windows(docs, text_col, max(1, train_windows // (len(KINDS) + 3)))])
    order = np.random.default_rng(8).permutation(len(samples))
    return train([samples[i] for i in order])


def spans_of(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(fixed spans, all spans): the field's entities join where no fixed span overlaps them."""
    if not text or not _MARK.search(text):
        return [], []
    base = base_spans(text)
    more = []
    for a, b in windows(text):
        more += decode(text, a, b, weights)
    taken = sorted((a, e) for a, _, e in base)
    starts, ends = [a for a, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    out = list(base)
    for a, k, e in more:
        i = np.searchsorted(starts, e) - 1
        if i < 0 or ends[i] <= a:
            out.append((a, k, e))
    return base, sorted(out)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: np.ndarray | None = None) -> DataFrame:
    """(doc_id, base, spans) for each document: arrays of kind, start and end in code points, by start, then kind.

    base are the fixed patterns' matches, spans those and the field's. Null and empty texts have none. Repeated rows and
    null ids are documents like any other. Overlapping spans of different kinds all stay. An empty table gives no rows;
    other columns are ignored. Very long texts are decoded window by window.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, text_col) if weights is None else weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        rows = lambda spans: [{"kind": KINDS[k], "start": a, "end": e} for a, k, e in spans]
        for b in batches:
            found = [spans_of(t.as_py(), held.value) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([rows(x) for x, _ in found], kind), pa.array([rows(y) for _, y in found], kind)], ["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def mask_column(spark: SparkSession, weights: np.ndarray, text: str = "text") -> Column:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets; null stays null."""
    held = spark.sparkContext.broadcast(weights)

    def masked(t: str | None) -> str | None:
        _, spans = spans_of(t, held.value)
        if not spans:
            return t
        out, at = [], 0
        for a, k, e in spans:
            if a >= at:
                out += [t[at:a], f"<{KINDS[k].upper()}>"]
            at = max(at, e)
        return "".join([*out, t[at:]])

    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    return F.pandas_udf(mask, "string")(F.col(text).cast("string"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and checksum of the fixed patterns' matches in every document (n_* count these), and all spans."""
    found = find_pii(read_spread(spark, f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
