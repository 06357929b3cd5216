"""Text functions for columns and SQL: feature-hash embeddings, readable text of html, fenced JSON, extractive summaries."""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The 64-bit FNV-1a constants, dimensions and weights of the feature hash, words that it passes over.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
DIMENSIONS, WORD_WEIGHT, GRAM_WEIGHT, PAIR_WEIGHT = 768, 1.0, 0.5, 0.7
STOP_WORDS = frozenset(
    "the a an and or of to in on for is are was were be by with as at that this it from its into than then but not no has have had will would can could should may might".split()
)

_WORD = re.compile(r"[^\W_]+(?:_[^\W_]+)*", re.UNICODE)


def fnv1a(parts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once, longest first columns of a padded matrix."""
    if not parts:
        return np.zeros(0, np.uint64)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    width = int(size.max())
    rows = np.zeros((len(parts), width), np.uint8)
    for i, p in enumerate(parts):
        rows[i, : len(p)] = np.frombuffer(p, np.uint8)
    h = np.full(len(parts), FNV_OFFSET, np.uint64)
    for k in range(width):
        live = size > k
        h[live] = (h[live] ^ rows[live, k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    return h


def hash_embed(text: str | None) -> np.ndarray:
    """Signed feature hashing of words, their padded character 3- to 5-grams and word pairs, log-damped and of unit length;
    a feature's kind is the first byte of what is hashed."""
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w and w not in STOP_WORDS]
    weight: dict[bytes, float] = defaultdict(float)
    for w in words:
        weight[b"w" + w.encode()] += WORD_WEIGHT
        padded = f"<{w}>"
        for n in (3, 4, 5):
            grams = [padded[i : i + n] for i in range(len(padded) - n + 1)]
            for g in grams:
                weight[b"c" + g.encode()] += GRAM_WEIGHT / math.sqrt(len(grams))
    for x, y in zip(words, words[1:], strict=False):
        weight[f"b{x} {y}".encode()] += PAIR_WEIGHT
    out = np.zeros(DIMENSIONS)
    keys = sorted(weight)
    h = fnv1a(keys)
    sign = np.where(h >> np.uint64(63), -1.0, 1.0)
    np.add.at(out, (h % np.uint64(DIMENSIONS)).astype(int), sign * np.log1p([weight[k] for k in keys]))
    norm = np.linalg.norm(out)
    return out / norm if norm else out


class _Reader(HTMLParser):
    SKIP = frozenset("script style noscript template svg head nav footer aside form button iframe select textarea".split())
    BREAK = frozenset("p div section article main br tr ul ol table blockquote pre header h1 h2 h3 h4 h5 h6 li".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []

    def handle_starttag(self, tag, attrs):
        if self.skip or tag in self.SKIP or any(k == "hidden" for k, _ in attrs):
            if tag not in ("br", "img", "hr", "input", "meta", "link"):
                self.skip.append(tag)
            return
        if tag in self.BREAK:
            self.out.append("\n")
        if re.fullmatch("h[1-6]", tag):
            self.out.append("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.out.append("- ")
        elif tag in ("td", "th"):
            self.out.append(" | ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
            return
        if tag in self.BREAK:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def html_to_text(page: str | None) -> str:
    """Readable text with # headings, - items and | cells, blank runs squeezed."""
    r = _Reader()
    r.feed(page or "")
    r.close()
    lines = [" ".join(x.split()) for x in "".join(r.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def _object(text: str) -> bool:
    try:
        return isinstance(json.loads(text), dict)
    except (ValueError, RecursionError):
        return False


def extract_json(text: str | None) -> str | None:
    """The object that a text is, else that of its last fenced block which is one, else its last balanced braces that are
    one; null if none is."""
    text = (text or "").strip()
    fenced = re.findall(r"```[^\n`]*\n(.*?)```|```(.*?)```", text, re.DOTALL)
    for b in (text, *reversed([x or y for x, y in fenced])):
        if _object(b):
            return b.strip()
    # braces from the last one back: each closing one with the opening one that balances it
    opened: list[int] = []
    pair: dict[int, int] = {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            pair[m.start()] = opened.pop()
    for end in sorted(pair, reverse=True):
        if _object(text[pair[end] : end + 1]):
            return text[pair[end] : end + 1]
    return None


def compress_text(text: str | None, query: str, budget: int) -> str:
    """The paragraphs that matter most to a query, in order, within a token budget: term weight, place and numbers score
    a paragraph; near copies of chosen ones are passed over and gaps are marked."""
    text = text or ""
    tokens = lambda t: [w.lower() for w in _WORD.findall(t) if len(w) > 1]
    size = lambda t: math.ceil(len(t) / 4)
    if size(text) <= budget:
        return text
    parts = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    words = [tokens(p) for p in parts]
    mean = sum(map(len, words)) / max(1, len(words))
    score = np.zeros(len(parts))
    for term in set(tokens(query)):
        df = sum(term in w for w in words)
        idf = math.log((len(parts) - df + 0.5) / (df + 0.5) + 1)
        for i, w in enumerate(words):
            tf = w.count(term)
            score[i] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / max(mean, 1e-9))) if tf else 0
    if score.max() > 0:
        score /= score.max()
    score = 2 * score + 0.5 / (1 + np.arange(len(parts))) + np.array([sum(bool(re.search(r"[0-9$%]|^[A-Z]", x)) for x in p.split()) / max(1, len(p.split())) for p in parts])
    chosen: dict[int, set] = {}
    used = 0
    for i in np.argsort(-score, kind="stable"):
        own = {tuple(words[i][k : k + 3]) for k in range(max(1, len(words[i]) - 2))}
        if used + size(parts[i]) > budget or any(len(own & o) > 0.85 * min(len(own), len(o)) for o in chosen.values()):
            continue
        chosen[int(i)] = own
        used += size(parts[i])
    out, last = [], -1
    for i in sorted(chosen):
        out += ["[...]"] * (i > last + 1) + [parts[i]]
        last = i
    return "\n\n".join(out + ["[...]"] * (last < len(parts) - 1))


def _embed(s: pd.Series) -> pd.Series:
    return pd.Series([hash_embed(t).tolist() for t in s])


def _readable(s: pd.Series) -> pd.Series:
    return pd.Series([html_to_text(t) for t in s], dtype=object)


def _json(s: pd.Series) -> pd.Series:
    return pd.Series([extract_json(t) for t in s], dtype=object)


def _summary(s: pd.Series, q: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([compress_text(*x) for x in zip(s, q, n, strict=True)], dtype=object)


def hash_embed_column(text: Column) -> Column:
    return F.pandas_udf(_embed, "array<double>")(text)


def html_to_text_column(page: Column) -> Column:
    return F.pandas_udf(_readable, "string")(page)


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL."""
    spark.udf.register("hash_embed", F.pandas_udf(_embed, "array<double>"))
    spark.udf.register("html_to_text", F.pandas_udf(_readable, "string"))
    spark.udf.register("extract_json", F.pandas_udf(_json, "string"))
    spark.udf.register("compress_text", F.pandas_udf(_summary, "string"))
