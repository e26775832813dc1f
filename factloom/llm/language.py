"""Language of documents and of their segments, by compression with per-language dictionaries.

A text is cut into sentences; code, paths, identifiers and quoted phrases are blanked out first, and letters are compared
without case and accents. Each sentence is compressed by zstandard with a raw-content dictionary per language; the
language with the smallest result is taken, and none if the margin to the next is narrow, or if no dictionary helps much.
Neighbouring sentences of one language make a segment.

The dictionaries are fitted on a bounded sample of labelled rows: about ``DOCS_PER_LANGUAGE`` documents of each label,
chosen by a hash of the id over the whole table, and at most ``SENTENCES_PER_DOC`` sentences of each, of ``FIT_CHARS``
characters at most. Wrong labels in the
sample are outvoted: a word-count model is fitted to the labels and relabels the sentences, three times over.

Null, empty and blank texts, and texts without a whole sentence, hold no language.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.store import spread

LANGUAGES = ("en", "vi", "fr", "de", "es", "pt")
#: Other names of the languages in labels: 3-letter codes and English names (fixed values).
NAMES = {
    "en": ("en", "eng", "english"), "vi": ("vi", "vie", "vietnamese"), "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"), "es": ("es", "spa", "spanish"), "pt": ("pt", "por", "portuguese"),
}
DOCS_PER_LANGUAGE, SENTENCES_PER_DOC, DICTIONARY_BYTES = 1000, 24, 96_000
MARGIN, GAIN, LEVEL, REMEMBERED = 0.12, 0.85, 9, 100_000
#: Sentences of more characters do not go into a dictionary, which they would fill alone; they are classified like all others.
FIT_CHARS = 600

#: Code, quoted or bracketed phrases, markup and links; the first look-ahead rules out most places at once.
_QUOTED = re.compile(
    r"""(?=[`~«“„("\[<&\x1bh])(?:```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|«[^»\n]*»|“[^”\n]*”|„[^“”\n]*[“”]|\(?"[^"\n]*"\)?|\[[^\]\n]*\]|<[^<>\n]{1,80}>|&\w+;|\x1b\[[\d;]*m|https?://\S+)""",
    re.S | re.I,
)
#: Pieces between white space that are paths, names of code or numbers; punctuation at their end stays.
_CODE = re.compile(r"(?<!\S)[^\s\\/$_\d(:>]*(?:[\\/$_\d]|(?<=\w)\(|::|->)\S*?(?=[.,;:!?…]*(?:\s|\Z))")
_LINE = re.compile(r"[^\n\r\x85\u2028\u2029]+")
_SENTENCE = re.compile(r"[^.!?…。]*[.!?…。]+(?=[\s\"'»”)\]]|\Z)|[^.!?…。]+[.!?…。]?")
_BULLET = re.compile(r"\s*(?:[-*•>#]+|\d*[.)])\s")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = re.compile("[\u0300-\u036f]+")


def _same_length(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def plain(sentence: str) -> str:
    """Lower-case words without accents."""
    s = sentence.lower()
    if not s.isascii():
        s = _MARKS.sub("", unicodedata.normalize("NFD", s.replace("đ", "d")))
    return " ".join(_WORD.findall(s))


def sentences(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, plain words) of each whole sentence; positions are code points of the text."""
    if not text:
        return []
    blanked = _CODE.sub(_same_length, _QUOTED.sub(_same_length, text))
    out = []
    for line in _LINE.finditer(blanked):
        b = _BULLET.match(line[0])
        start = line.start() + (b.end() if b else 0)
        for m in _SENTENCE.finditer(blanked, start, line.end()):
            body = m[0].strip()
            if not body or body[-1] not in ".!?…。":
                continue
            words = plain(body)
            if words:
                lead = len(m[0]) - len(m[0].lstrip())
                out.append((m.start() + lead, m.end(), words))
    return out


def named(label: str | None) -> str | None:
    """The language that a label names."""
    base = re.split(r"[-_]", (label or "").strip().lower())[0]
    return next((k for k, v in NAMES.items() if base in v), None)


def label_column(c):
    base = F.lower(F.regexp_extract(F.trim(c), r"^([^-_]*)", 1))
    out = F.lit(None).cast("string")
    for k, v in NAMES.items():
        out = F.when(base.isin(*v), k).otherwise(out)
    return out


class Model:
    """Dictionaries of the languages, as raw bytes; compressors are made once per process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dictionaries

    def _ready(self) -> None:
        params = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self._with = []
        for lang, raw in self.dictionaries.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self._with.append((lang, zstandard.ZstdCompressor(dict_data=d, level=LEVEL, **params)))
        self._alone = zstandard.ZstdCompressor(level=LEVEL, **params)
        self._known: dict[str, tuple] = {}

    def __getstate__(self):
        return {"dictionaries": self.dictionaries}

    def classify(self, words: str) -> tuple[str | None, float]:
        """(language, confidence) of plain words; None if the margin is narrow."""
        if not hasattr(self, "_with"):
            self._ready()
        hit = self._known.get(words)
        if hit is None:
            raw = words.encode()
            sizes = sorted((len(c.compress(raw)), lang) for lang, c in self._with)
            alone = len(self._alone.compress(raw))
            best, second = sizes[0][0], sizes[1][0] if len(sizes) > 1 else alone
            margin = (second - best) / max(second, 1)
            hit = (sizes[0][1], round(margin, 6)) if margin >= MARGIN and best <= GAIN * alone else (None, round(margin, 6))
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            self._known[words] = hit
        return hit


def clean(labelled: list[tuple[str, str]], rounds: int = 3) -> list[tuple[str, str]]:
    """Relabel (language, words) by a word-count model fitted to the labels themselves, so that stray labels are outvoted."""
    labels = [lang for lang, _ in labelled]
    bags = [set(w.split()) for _, w in labelled]
    names = sorted(set(labels))
    for _ in range(rounds):
        counts = {k: Counter() for k in names}
        size = Counter(labels)
        for lang, bag in zip(labels, bags):
            counts[lang].update(bag)
        # the share of a language's sentences that has the word
        table: dict[str, list[float]] = {}
        for w in set().union(*bags) if bags else ():
            table[w] = [math.log((counts[k][w] + 0.05) / (size[k] + 1)) for k in names]
        labels = [names[max(range(len(names)), key=lambda i: (sum(table[w][i] for w in bag), -i))] if bag else lang for lang, bag in zip(labels, bags)]
    return [(lang, w) for lang, (_, w) in zip(labels, labelled)]


def build(labelled: list[tuple[str, str]], languages: tuple[str, ...] = LANGUAGES) -> Model:
    """A model from sampled (language, words)."""
    by: dict[str, dict[str, None]] = {k: {} for k in languages}
    for lang, w in clean(sorted(labelled)):
        if lang in by:
            by[lang][w] = None
    return Model({k: _packed(by[k]) for k in languages if by[k]})


def _packed(lines: dict[str, None]) -> bytes:
    """Dictionary of a language: its sentences in the order of a hash, those first that bring word triples not yet held."""
    held: set[tuple[str, ...]] = set()
    first, rest = [], []
    for line in sorted(lines, key=lambda x: hashlib.md5(x.encode()).digest()):
        w = line.split()
        new = set(zip(w, w[1:], w[2:])) - held
        held |= new
        (first if new else rest).append(line)
    # the end of a raw dictionary is the cheapest to refer to, so what is cut off is the start
    return "\n".join([*rest[::-1], *first[::-1]]).encode()[-DICTIONARY_BYTES:]


def _sampled(batches):
    for b in batches:
        rows = []
        for lang, text in zip(*(c.to_pylist() for c in b.columns)):
            found = sorted({w for _, _, w in sentences(text) if len(w) <= FIT_CHARS})
            step = max(1, len(found) // SENTENCES_PER_DOC)
            rows += [(lang, w) for w in found[::step][:SENTENCES_PER_DOC]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (list(zip(*rows)) or [(), ()])], ["lang", "words"])


def fit(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Model from about ``per_language`` documents of each label of ``docs(doc_id, text, lang)``."""
    known = docs.select("doc_id", "text", label_column(F.col("lang")).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    have = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in have.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = known.where(unit < share).select("lang", "text").mapInArrow(_sampled, "lang string, words string").collect()
    return build([(r.lang, r.words) for r in rows])


def segments_of(model: Model, text: str | None) -> list[tuple[int, int, str, int, float]]:
    """(start, end, language, sentences, confidence) of each run of sentences of one language."""
    out: list[list] = []
    for start, end, words in sentences(text):
        lang, sure = model.classify(words)
        if lang is None:
            continue
        if out and out[-1][2] == lang:
            s = out[-1]
            s[1], s[3], s[4] = end, s[3] + 1, s[4] + sure
        else:
            out.append([start, end, lang, 1, sure])
    return [(a, b, lang, n, round(c / n, 6)) for a, b, lang, n, c in out]


def _segments(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(doc, i, *s) for i, s in enumerate(segments_of(model, text))]
            cols = list(zip(*rows)) or [()] * 7
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "segment", "start", "end", "lang", "sentences", "confidence"])

    return run


def segments(docs: DataFrame, model: Model) -> DataFrame:
    """A row per segment of ``docs(doc_id, text)``; the model (under a megabyte by its parameters) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread(docs.select(F.col("doc_id").cast("bigint"), "text"), "doc_id")
    return rows.mapInArrow(_segments(shared), "doc_id bigint, segment int, start int, end int, lang string, sentences int, confidence double")


def documents(docs: DataFrame, segs: DataFrame) -> DataFrame:
    """A row per document: its languages, the one with most text with a confidence, and whether its label names just that."""
    per = segs.groupBy("doc_id", "lang").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.avg("confidence").alias("c"))
    doc = per.groupBy("doc_id").agg(F.array_sort(F.collect_list("lang")).alias("langs"), F.max(F.struct("n", F.lit(None).cast("string"), "lang", "c")).alias("m"), F.sum("n").alias("total"))
    doc = doc.select("doc_id", "langs", F.col("m.lang").alias("lang"), F.round(F.col("m.c") * F.col("m.n") / F.col("total"), 6).alias("confidence"))
    label = label_column(F.col("label"))
    out = docs.select("doc_id", F.col("lang").alias("label")).join(doc, "doc_id", "left")
    right = (F.size("langs") == 1) & label.eqNullSafe(F.col("langs")[0])
    return out.select("doc_id", "lang", "confidence", "langs", "label", F.when(F.col("langs").isNotNull(), ~right).alias("is_case"))
