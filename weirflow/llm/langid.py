"""Language identification: script ranges, per-word scores and a Viterbi pass that labels spans.

A word's script, by Unicode ranges, narrows the languages to those that were seen to write in it. Among these, a word
has a score for each language: the log likelihood of its letter n-grams of one to four, boundaries included. Over a text's
words, the best path through the languages pays SWITCH for each change, which labels the spans of mixed-language texts. The
text's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, id_text_crc, release, require

#: Nats that a change of language costs; about what three clear words bring in.
SWITCH = 12.0
#: The classifier is fitted on about so many documents of each language that occurs, taken by a hash, and on about MOST in
#: all (twice that at the very most); none of over SAMPLE_CHARS. So at most 240 MB of texts come to the driver.
SAMPLE, MOST, SAMPLE_CHARS = 600, 6000, 20_000
#: Letters of a longer word that go through the Viterbi pass as one.
PIECE = 64
ORDERS = (1, 2, 3, 4)
#: n-grams kept, by frequency, and the least share of a language's letters that makes a script one of its own.
GRAMS, SCRIPT_SHARE = 200_000, 0.01
#: What a task keeps: parts of texts, twice, and words with scores (at this number it forgets them all). Words in one pass.
CACHE, CORES, PASS_WORDS = 200_000, 600_000, 1_000_000
#: What a language that doesn't write in a word's script gets for it.
FOREIGN = -50.0
UNKNOWN = "und"
#: The least score of a text that the filter keeps: its language holds at least half of its letters.
LEAST = 0.5

#: First code points of Unicode ranges, and the script whose letters begin there.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Other"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"),
    (0x1400, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"),
    (0x1CC0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Other"),
    (0x2DE0, "Cyrillic"), (0x2E00, "Other"), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"),
    (0x3190, "Other"), (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"),
    (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"),
    (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_STARTS = [s for s, _ in SCRIPT_STARTS]
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def core(part: str) -> str:
    """The letters of what stands between white space, in lower case."""
    if not part.isalpha():
        part = _NOT_LETTERS.sub("", part)
        if not part.isalpha():  # superscripts and the like
            part = "".join(filter(str.isalpha, part))
    return part.lower()


def script(word: str) -> str:
    """The script that most of a word's letters are in; of equally many, the first to occur."""
    if word.isascii():
        return "Latin"
    return Counter(SCRIPT_STARTS[bisect_right(_STARTS, ord(c)) - 1][1] for c in word).most_common(1)[0][0]


def grams(word: str) -> list[str]:
    s = f" {word} "
    return [s[i : i + n] for n in ORDERS for i in range(len(s) - n + 1)]


def pieces(word: str) -> list[tuple[str, str, int]]:
    """A word in pieces of PIECE letters: (letters, text with context, n-grams of each order that begin there).

    Each n-gram of the word begins in one piece, so that the pieces' n-grams are those of the word.
    """
    n = len(word)
    s = f" {word} "
    out = []
    for a in range(0, n, PIECE):
        b = min(a + PIECE, n)
        start, end = a + 1 if a else 0, b + 1 if b < n else n + 2
        out.append((word[a:b], s[start : end + ORDERS[-1] - 1], end - start))
    return out


class Model:
    """Scores of letter n-grams for each language, and the scripts that languages are written in."""

    def __init__(self, sample: list[tuple[str, str]]):
        """sample: (language, text)."""
        self.langs = sorted({lang for lang, _ in sample})
        words: dict[str, Counter] = {lang: Counter() for lang in self.langs}
        for lang, text in sample:
            words[lang].update(text.split())
        n = len(self.langs)
        counts: list[Counter] = []
        total_count: Counter = Counter()
        letters: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for k, lang in enumerate(self.langs):
            cores: Counter = Counter()
            for part, times in words[lang].items():
                cores[core(part)] += times
            own: Counter = Counter()
            for w, times in cores.items():
                if w:
                    letters[script(w)][k] += times * len(w)
                    for g in grams(w):
                        own[g] += times
            counts.append(own)
            total_count.update(own)
        kept = sorted(total_count, key=lambda g: (-total_count[g], g))[:GRAMS]
        self.grams = {g: i for i, g in enumerate(kept)}
        seen = np.full((len(kept), n), 0.5)
        for k, own in enumerate(counts):
            seen[:, k] += np.fromiter((own[g] for g in kept), np.float64, len(kept))
        logs = np.log(seen / np.maximum(seen.sum(0), 1))
        #: What n-grams of a word add up to, as evidence against the mean of all languages; the last row is for unknown ones.
        self.table = np.vstack([logs - logs.sum(1, keepdims=True) / max(n, 1), np.zeros((1, n))]).astype(np.float32) / len(ORDERS)
        total = sum(letters.values(), np.zeros(n)) + 1e-9
        self.scripts = {s: np.where(v / total >= SCRIPT_SHARE, 0.0, FOREIGN).astype(np.float32) for s, v in letters.items() if (v / total >= SCRIPT_SHARE).any()}

    def score(self, words: list[str | tuple[str, str, int]]) -> np.ndarray:
        """A row for each word of letters, or piece of one; zeros for a word in a script that no language was seen in."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        get, unknown = self.grams.get, len(self.grams)
        flat: list[int] = []
        starts, rows = [], []
        for i, word in enumerate(words):
            w = word if isinstance(word, str) else word[0]
            if w and (s := self.scripts.get(script(w))) is not None:
                starts.append(len(flat))
                rows.append(i)
                if w is word:
                    flat.extend([get(g, unknown) for g in grams(w)])
                else:
                    _, text, begun = word
                    flat.extend([get(text[j : j + n], unknown) for n in ORDERS for j in range(min(begun, len(text) - n + 1))])
                out[i] = s
        if rows:
            out[rows] += np.add.reduceat(self.table[flat], starts, axis=0)
        return out


def viterbi(scores: np.ndarray, words: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """For each text, given as rows of scores, the language number of each word on the best path.

    All texts go on together, a word at a time; at a tie, a path stays in its language, and the first language wins.
    """
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order])
    if not len(sizes) or not sizes[0] or not scores.shape[1]:
        return [np.zeros(len(w), np.int16) for w in words]
    offsets = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = np.concatenate([words[i] for i in order])
    langs = scores.shape[1]
    own = np.arange(langs, dtype=np.int16)
    came = np.zeros((len(flat), langs), np.int16)
    best = np.zeros((len(order), langs), np.float64)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # texts of more than t words
    for t in range(sizes[0]):
        n = active[t]
        at = offsets[:n] + t
        now = best[:n]
        if t:
            top = now.argmax(1)
            high = now[np.arange(n), top] - switch
            stay = now >= high[:, None]
            came[at] = np.where(stay, own, top[:, None])
            now = np.maximum(now, high[:, None])
        best[:n] = now + scores[flat[at]]
    out = np.empty(len(flat), np.int16)
    state = best.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        n = active[t]
        at = offsets[:n] + t
        out[at] = state[:n]
        state[:n] = came[at, state[:n]]
    result: list[np.ndarray] = [np.empty(0)] * len(words)
    for i, o, s in zip(order, offsets, sizes, strict=True):
        result[i] = out[o : o + s]
    return result


class Labeller:
    """Labels texts by a model, with a cache of words."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self._forget()

    def _forget(self) -> None:
        self.parts = Recent(self._row, CACHE)
        self.rows: dict[str | tuple[str, str, int], int] = {}
        self.new: list[str | tuple[str, str, int]] = []
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.letters = np.zeros(0, np.int64)

    def _row(self, part: str) -> int:
        return self._place(core(part))

    def _place(self, word: str | tuple[str, str, int]) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows[word] = len(self.rows)
            self.new.append(word)
        return row

    def _learn(self) -> None:
        self.scores = np.concatenate([self.scores, self.model.score(self.new)])
        self.letters = np.concatenate([self.letters, np.fromiter((len(w if isinstance(w, str) else w[0]) for w in self.new), np.int64, len(self.new))])
        self.new = []

    def _read(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        """Rows of the words; those of a word's pieces one after the other, and then the number of each row's word."""
        if not parts or max(map(len, parts)) <= PIECE:
            return np.fromiter(map(self.parts.__getitem__, parts), np.int64, len(parts)), None
        rows: list[int] = []
        of: list[int] = []
        for i, part in enumerate(parts):
            if len(part) > PIECE and len(word := core(part)) > PIECE:
                own = [self._place(p) for p in pieces(word)]
            else:
                own = [self.parts[part]]
            rows += own
            of += [i] * len(own)
        return np.array(rows, np.int64), np.array(of, np.int64)

    def paths(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """For each text: rows of its words in self.scores, the language number of each, and the numbers of their words if
        there are pieces. Use them before the next."""
        read: list[tuple[np.ndarray, np.ndarray | None]] = []
        size = 0
        for text in texts:
            if not read and len(self.rows) > CORES:
                self._forget()
            parts = (text or "").split()
            read.append(self._read(parts))
            size += len(parts) + len(text or "") // PIECE
            if size >= PASS_WORDS:
                yield from self._pass(read)
                read, size = [], 0
        yield from self._pass(read)

    def _pass(self, read: list[tuple[np.ndarray, np.ndarray | None]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        words = [rows for rows, _ in read]
        if self.new:
            self._learn()
        yield from zip(words, viterbi(self.scores, words, self.switch), (of for _, of in read), strict=True)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float, list[tuple[str, int, int]]]]:
        """For each text: its language, a score, and its spans (language, first word, word after the last).

        A word whose pieces are of several languages lies in the spans of each of them.
        """
        langs = self.model.langs
        for words, path, of in self.paths(texts):
            letters = self.letters[words]
            if not langs or not letters.any():
                yield UNKNOWN, 0.0, []
                continue
            held = np.bincount(path, weights=letters, minlength=len(langs))
            best = int(held.argmax())
            totals = self.scores[words].astype(np.float64).sum(0)
            lead = totals[best] - max((totals[k] for k in range(len(langs)) if k != best), default=-100.0)
            sure = 1.0 / (1.0 + np.exp(-np.clip(lead / np.sqrt(len(words)), -30, 30)))
            cuts = np.flatnonzero(np.diff(path)) + 1
            edges = [0, *cuts.tolist(), len(path)]
            spans = [(langs[int(path[a])], *((a, b) if of is None else (int(of[a]), int(of[b - 1]) + 1))) for a, b in zip(edges, edges[1:], strict=False)]
            yield langs[best], float(held[best] / held.sum() * sure), spans


def train(docs: DataFrame, held_out: int = 1, folds: int = 3, sample: int = SAMPLE) -> Model:
    """A model from a bounded sample of documents with a language, outside of the held-out fold of crc32(doc_id).

    How many documents each language has is counted over all documents; every language that occurs is learned. Rows that
    repeat a text count once. The model has a number for each language and each of at most GRAMS n-grams.
    """
    require(docs, "doc_id", "text", "lang")
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (id_text_crc("doc_id", folds) != held_out))
    steps = 1 << 30
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    each = min(sample, -(-MOST // max(len(counts), 1)))
    shares = {lang: min(steps, round(steps * each / n)) for lang, n in counts.items()}
    of = F.map_from_arrays(F.lit(list(shares)).cast("array<string>"), F.lit(list(shares.values())).cast("array<bigint>"))
    picked = usable.where((F.length("text") <= SAMPLE_CHARS) & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)) < F.element_at(of, F.col("lang"))))
    rows = picked.select("lang", "text").distinct().orderBy(F.xxhash64("text", "lang"), "lang", "text").limit(2 * MOST)
    return Model([(r["lang"], r["text"]) for r in rows.collect()])


PREDICTIONS = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,begin:int,end:int>>"


def predict(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and the spans of each row's whole text.

    A NULL text, or one without a letter, is UNKNOWN with score 0 and without spans. A text in scripts that no learned
    language is written in gets the first language, with a score of at most a half. Only doc_id and text are read; rows
    that repeat each give a row, and an empty table none.
    """
    require(docs, "doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("lang", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        labeller = Labeller(sent.value, switch)
        for batch in batches:
            out = list(labeller.predict(batch.column(1).to_pylist()))
            langs, scores, spans = zip(*out, strict=True) if out else ((), (), ())
            rows = [[{"lang": lang, "begin": a, "end": b} for lang, a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rows, span)], names=["doc_id", "lang_pred", "score", "spans"])
            batch = out = langs = scores = spans = rows = None  # not held while the next one comes
        labeller = None
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTIONS)


def keep_known(docs: DataFrame, model: Model, switch: float = SWITCH, least: float = LEAST) -> DataFrame:
    """docs whose text is in a known language with a score of at least least; lang becomes the language that was found.

    All other columns stay, and lang as well where the table has none of that name and of text. NULL texts and those without
    a letter go. If no language was learned, texts with a letter stay as they are. Repeated rows each stay or go; an empty
    table gives an empty one.
    """
    require(docs, "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("lang") if "lang" in names and docs.schema["lang"].dataType.typeName() == "string" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        labeller = Labeller(sent.value, switch) if sent.value.langs else None
        for batch in batches:
            texts = batch.column(names.index("text")).to_pylist()
            if labeller is None:
                yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in texts], pa.bool_()))
                continue
            found = [(lang, score) for lang, score, _ in labeller.predict(texts)]
            if at is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([lang for lang, _ in found], batch.schema.field(at).type))
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))
            batch = texts = found = None  # not held while the next one comes
        labeller = None
        release()

    return docs.mapInArrow(run, docs.schema)
