"""Document and segment language from a byte convolutional network.

The network embeds bytes, runs filters of several widths over fixed-length windows, takes the maximum of each filter and
ends in a softmax. It is trained in numpy on a bounded sample of labelled texts (SAMPLE_TEXTS per language, documented
bound); a second round leaves out training windows which the first model confidently contradicts, as labels are noisy.
Every sentence of every text is then classified in batches of windows; the windows of one sentence are averaged.
Neighbouring sentences of one language form a segment; a lone sentence needs more certainty than a run. The languages are
those that the labels name; a segment that the network is not sure of is of the language OTHER.

Defined results: null or blank text gives no rows; a text without any whole sentence gives no rows; labels in any
coding are read case-blind, unknown ones state nothing; without any labelled text there are no rows.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papersieve.llm.sentences import sentence_spans
from papersieve.session import read_table, spread

SAMPLE_TEXTS = 600  # labelled texts per language at most; the model is fitted on no more, whatever the input
SAMPLE_SENTENCES = 8  # sentences used of one sampled text
SAMPLE_CHARS = 2000  # characters of a sampled text from which these sentences are taken
LEAST_TEXTS = 5  # sampled texts that a language must have to be learnt
WINDOW = 128
BLOCK = 8  # bytes; sentences begin at multiples of it in a batch, so maxima are taken block by block first
WIDTHS, FILTERS, DIM = (4, 9), 20, 6
EPOCHS, BATCH = 5, 64
OTHER, SURE = "und", 0.5  # the language of segments of less than this confidence

# Codings of the language labels.
LABELS = {
    "en": "en eng english", "hi": "hi hin hindi हिन्दी हिंदी", "mr": "mr mar marathi मराठी", "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français", "es": "es spa spanish español", "ja": "ja jpn japanese 日本語", "th": "th tha thai ไทย",
}
_CODE = {word: code for code, words in LABELS.items() for word in words.split()}


_NO_CODE = ("xx", "zz", "na", "un")


def label_code(label: str | None) -> str | None:
    """The two-letter code a label states, in whatever coding; None if it states none. Codes outside the table stand as
    they are, so further languages are learnt from their labels."""
    if label is None:
        return None
    key = re.split(r"[-_ ]", label.strip().lower())[0]
    return _CODE.get(key) or (key if re.fullmatch("[a-z]{2}", key) and key not in _NO_CODE else None)


def label_column(col: Column) -> Column:
    key = F.split_part(F.translate(F.lower(F.trim(col)), "_ ", "--"), F.lit("-"), F.lit(1))
    pairs = [F.lit(x) for item in _CODE.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[key], F.when(key.rlike("^[a-z]{2}$") & ~key.isin(*_NO_CODE), key))


_CONTACT = re.compile(r"@|\[at\]|\(at\)| AT |\[dot\]|www\.|https?:|\+\d|\d{5,}|\d{3,}[- ]\d{3,}|[०-९]{4,}[-) ]")
_THAI, _KANA = re.compile(r"[฀-๿]"), re.compile(r"[぀-ヿ]")
_LATIN_WORD = re.compile(r"[^\W\d_]{2,}")


def is_sentence(text: str) -> bool:
    """Running text, as against names, headings and contact lines."""
    if len(text) < 12:
        return False
    if text.isascii():
        pass
    elif _THAI.search(text):
        return len(_THAI.findall(text)) >= 15
    elif _KANA.search(text):
        return text.rstrip("」』）\"'")[-1:] in "。！？" or len(text) >= 25
    end = text.rstrip("\"'”’»)]")[-1:]
    return end in (".", "?", "!", "।", "॥", "…") and len(text.split()) >= 4


def windows(text: str) -> np.ndarray:
    """Fixed-length byte windows over a whole text, zero-padded at the end; zeros are a learnt padding symbol."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = max(1, -(-len(raw) // WINDOW))
    out = np.zeros((n, WINDOW), np.uint8)
    out.reshape(-1)[: len(raw)] = raw
    if n > 1 and len(raw) % WINDOW and len(raw) % WINDOW < WINDOW // 2:
        out[-1] = raw[-WINDOW:]  # the last window is shifted back instead of being mostly padding
    return out


def _block_maxima(z: np.ndarray) -> np.ndarray:
    """Maxima over the middle axis of (blocks, BLOCK, filters), by halves, as these lie together."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        z = np.maximum(z[:, :half], z[:, half:])
    return z[:, 0]


class ByteNet:
    """Multi-width byte convolution, max pooling, softmax."""

    def __init__(self, langs: tuple[str, ...], seed: int = 7):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.emb = r.normal(0, 0.5, (256, DIM)).astype(np.float32)
        self.conv = [r.normal(0, (1 / (w * DIM)) ** 0.5 * 2, (w * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _activations(self, raw: np.ndarray) -> np.ndarray:
        """All filters at all places of a byte stream, (places, filters). Places a filter width apart are one matrix
        product over the embedded bytes as they lie, so nothing is copied. The stream ends with zeros for the widest."""
        n = len(raw)
        e = self.emb.take(np.concatenate([raw, np.zeros(max(WIDTHS), np.uint8)]), axis=0).reshape(-1)
        out = np.empty((n, FILTERS * len(WIDTHS)), np.float32)
        for j, (w, k) in enumerate(zip(WIDTHS, self.conv)):
            for first in range(min(w, n)):
                rows = -(-(n - first) // w)
                part = e[first * DIM : (first + rows * w) * DIM]
                np.matmul(part.reshape(rows, w * DIM), k, out=out[first::w, j * FILTERS : (j + 1) * FILTERS])
        return out

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of zero-padded windows and the places of their maxima; filters stay inside the text."""
        n = len(x)
        z = self._activations(x.reshape(-1)).reshape(n, WINDOW, -1)
        size = np.maximum(np.count_nonzero(x, axis=1), 1)
        part = np.flatnonzero(size < WINDOW)
        for j, w in enumerate(WIDTHS):
            own = slice(j * FILTERS, (j + 1) * FILTERS)
            z[:, WINDOW - w + 1 :, own] = -np.inf
            i, over = np.nonzero(np.arange(WINDOW - w + 1)[None] > np.maximum(size[part] - w, 0)[:, None])
            z[part[i], over, own] = -np.inf
        # The first place of a maximum lies in the first block that has it.
        z = z.reshape(n, WINDOW // BLOCK, BLOCK, -1)
        tops = _block_maxima(z.reshape(-1, BLOCK, z.shape[3])).reshape(n, -1, z.shape[3])
        block = tops.argmax(1)
        inside = z[np.arange(n)[:, None], block, :, np.arange(z.shape[3])]
        best = np.take_along_axis(tops, block[:, None], 1)[:, 0]
        return np.maximum(best + np.concatenate(self.bias), 0), block * BLOCK + inside.argmax(2)

    def _softmax(self, features: np.ndarray) -> np.ndarray:
        z = features @ self.out + self.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def sentence_probabilities(self, sentences: list[str], batch: int = 1 << 14) -> np.ndarray:
        """(sentences, languages): the geometric mean over the windows of each sentence, every byte read once."""
        parts, now, size = [], [], 0
        for s in sentences:
            raw = s.encode("utf-8", "replace") or b"\0"
            now.append(raw)
            size += len(raw)
            if size >= batch:
                parts.append(self._batch(now))
                now, size = [], 0
        if now:
            parts.append(self._batch(now))
        return np.concatenate(parts) if parts else np.empty((0, len(self.langs)), np.float32)

    def _batch(self, raws: list[bytes]) -> np.ndarray:
        stream = np.frombuffer(b"".join(r + bytes(-len(r) % BLOCK) for r in raws), np.uint8)
        sizes = np.array([len(r) for r in raws])
        room = -(-sizes // BLOCK) * BLOCK
        starts = np.cumsum(room) - room
        z = self._activations(stream)
        for j, w in enumerate(WIDTHS):
            # The last places of a sentence, where the filter would run into the next one; its first place always stays.
            inside = np.maximum(sizes - w + 1, 1)
            count = room - inside
            over = np.repeat(starts + inside, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            z[over, j * FILTERS : (j + 1) * FILTERS] = -np.inf
        blocks = _block_maxima(z.reshape(-1, BLOCK, z.shape[1]))
        # A last window of less than half the length belongs to the one before.
        windows = np.maximum(1, (sizes + WINDOW // 2) // WINDOW)
        owner = np.repeat(np.arange(len(raws)), windows)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        pooled = np.maximum.reduceat(blocks, (starts[owner] + nth * WINDOW) // BLOCK, axis=0)
        logs = np.log(self._softmax(np.maximum(pooled + np.concatenate(self.bias), 0)) + 1e-9)
        mean = np.add.reduceat(logs, np.cumsum(windows) - windows, axis=0) / windows[:, None]
        p = np.exp(mean - mean.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> "ByteNet":
        r = np.random.default_rng(seed)
        params = [self.emb, *self.conv, *self.bias, self.out, self.out_bias]
        m1, m2, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        nw = len(WIDTHS)
        for epoch in range(epochs):
            order = r.permutation(len(x))
            rate = 0.004 * (0.5 ** max(0, epoch - 2))
            for i in range(0, len(x), BATCH):
                b = order[i : i + BATCH]
                xb, n = x[b], len(b)
                wide = xb.reshape(-1).astype(np.intp)
                f, at = self._pool(xb)
                mask = (r.random(f.shape) > 0.3).astype(np.float32) / 0.7
                fd = f * mask
                p = self._softmax(fd)
                # Smoothed targets: labels are partly wrong.
                target = np.full(p.shape, 0.05 / len(self.langs), np.float32)
                target[np.arange(n), y[b]] += 0.95
                g = (p - target) / n
                grads = [np.zeros_like(q) for q in params]
                grads[-2], grads[-1] = fd.T @ g, g.sum(0)
                gf = (g @ self.out.T) * mask * (f > 0)
                for j, w in enumerate(WIDTHS):
                    own = slice(j * FILTERS, (j + 1) * FILTERS)
                    gj = gf[:, own]
                    grads[1 + nw + j] = gj.sum(0)
                    under = np.minimum(at[:, own, None] + np.arange(w), WINDOW - 1)  # (n, filters, w): the bytes under each maximum
                    bytes_at = wide.take(under + WINDOW * np.arange(n)[:, None, None])
                    e = self.emb.take(bytes_at, axis=0).reshape(n, FILTERS, w * DIM)
                    grads[1 + j] = np.einsum("nfk,nf->kf", e, gj)
                    # Filters without a gradient add nothing.
                    i, k = np.nonzero(gj)
                    ge = (gj[i, k, None] * self.conv[j].T[k]).reshape(-1, DIM)
                    flat = bytes_at[i, k].reshape(-1)
                    for d, column in enumerate(ge.T.astype(np.float64)):
                        grads[0][:, d] += np.bincount(flat, column, 256).astype(np.float32)
                t += 1
                for q, gq, a, v in zip(params, grads, m1, m2):
                    a += 0.1 * (gq - a)
                    v += 0.01 * (gq * gq - v)
                    q -= rate * (a / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        return self


def train(samples: list[tuple[str, str]]) -> ByteNet | None:
    """A model from (language, sentence) samples; the second round leaves out windows the first one contradicts. None
    without samples."""
    if not samples:
        return None
    langs = tuple(sorted({lang for lang, _ in samples}))
    xs, ys = [], []
    for lang, text in samples:
        w = windows(text)
        xs.append(w)
        ys.append(np.full(len(w), langs.index(lang)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    first = ByteNet(langs).fit(x, y, epochs=3)
    p = np.concatenate([first._softmax(first._pool(x[i : i + 512])[0]) for i in range(0, len(x), 512)])
    clean = (p.argmax(1) == y) | (p.max(1) < 0.6)
    return ByteNet(langs, 11).fit(x[clean], y[clean])


def texts(spark: SparkSession, data_dir: str) -> DataFrame:
    """(tbl, doc_id, stated, text) of both tables; repeated rows are left in, results are made distinct."""
    d = read_table(spark, data_dir, "documents").select(F.lit("documents").alias("tbl"), F.col("doc_id"), label_column(F.col("lang")).alias("stated"), "text")
    p = read_table(spark, data_dir, "preprocessed").select(F.lit("preprocessed").alias("tbl"), F.col("prep_id").alias("doc_id"), label_column(F.col("language")).alias("stated"), F.col("original_full_text").alias("text"))
    return d.unionByName(p).where("text is not null and doc_id is not null")


def training_sample(all_texts: DataFrame) -> DataFrame:
    """(stated, bucket, text): at most SAMPLE_TEXTS texts per language, one from each hash bucket, so map-side aggregation
    bounds the shuffle."""
    h = F.xxhash64("tbl", "doc_id")
    known = all_texts.where("stated is not null and length(text) > 60")
    return known.groupBy("stated", F.pmod(h, F.lit(SAMPLE_TEXTS)).alias("bucket")).agg(F.min_by(F.substring("text", 1, SAMPLE_CHARS), h).alias("text"))


def labelled_sentences(pdf: pd.DataFrame) -> list[tuple[str, str]]:
    """(language, sentence) of a sample, in the order of its keys."""
    pdf = pdf.sort_values(["stated", "bucket"])
    count, out = Counter(pdf["stated"]), []
    for lang, text in zip(pdf["stated"], pdf["text"]):
        if count[lang] >= LEAST_TEXTS:
            spans = [text[s:e] for s, e in sentence_spans(text)]
            out += [(lang, s) for s in spans if is_sentence(s) and not _CONTACT.search(s)][:SAMPLE_SENTENCES]
    return out


def fitted(all_texts: DataFrame) -> ByteNet | None:
    """The model of the bounded sample, trained in one task of an executor; some 50 kB come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        yield pd.DataFrame({"model": [pickle.dumps(train(labelled_sentences(pd.concat(parts)) if parts else []))]})

    return pickle.loads(training_sample(all_texts).repartition(1).mapInPandas(run, "model binary").first()["model"])


def segments_of(text: str, net: ByteNet) -> list[tuple[int, int, str, float, int]]:
    return segments_of_many([text], net)[0]


def segments_of_many(batch: list[str], net: ByteNet) -> list[list[tuple[int, int, str, float, int]]]:
    """For each text its (start, end, language, confidence, sentences): runs of sentences of one language; sentences is 1
    where one of them is no contact line, else 0."""
    spans = [(k, s, e) for k, t in enumerate(batch) for s, e in sentence_spans(t) if is_sentence(t[s:e])]
    out: list[list] = [[] for _ in batch]
    if not spans:
        return out
    pieces = [batch[k][s:e] for k, s, e in spans]
    p = net.sentence_probabilities(pieces)
    tops, sure = p.argmax(1).tolist(), p.max(1)
    i = 0
    while i < len(spans):
        k, first = spans[i][0], i
        while i < len(spans) and spans[i][0] == k:
            i += 1
        best = tops[first:i]
        n = len(best)
        if len(set(best)) > 1:
            main = Counter(best).most_common(1)[0][0]
            for x in range(n):
                # A lone sentence that differs from both neighbours needs certainty; a contact line never stands alone.
                alone = (x == 0 or best[x - 1] != best[x]) and (x + 1 == n or best[x + 1] != best[x])
                beside = best[x - 1] if x else best[x + 1]
                if alone and best[x] != main and ((sure[first + x] < 0.6 and p[first + x][beside] > 0.15) or _CONTACT.search(pieces[first + x])):
                    best[x] = beside
        x = 0
        while x < n:
            y = x
            while y + 1 < n and best[y + 1] == best[x]:
                y += 1
            conf = float(p[first + x : first + y + 1, best[x]].mean())
            whole = any(not _CONTACT.search(c) for c in pieces[first + x : first + y + 1])
            out[k].append((spans[first + x][1], spans[first + y][2], net.langs[best[x]], conf, int(whole)))
            x = y + 1
    return out


def segments(all_texts: DataFrame) -> DataFrame:
    """(tbl, doc_id, stated, start_char, end_char, lang, confidence, sentences) for every text."""
    spark = all_texts.sparkSession
    net = spark.sparkContext.broadcast(fitted(all_texts))
    schema = "tbl string, doc_id long, stated string, start_char int, end_char int, lang string, confidence double, sentences int"
    if net.value is None:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i : i + 256]
                rows = [(tbl, d, st, *seg) for tbl, d, st, segs in zip(part["tbl"], part["doc_id"], part["stated"], segments_of_many(list(part["text"]), net.value)) for seg in segs]
                yield pd.DataFrame(rows, columns=["tbl", "doc_id", "stated", "start_char", "end_char", "lang", "confidence", "sentences"])

    return spread(all_texts, "tbl", "doc_id").mapInPandas(run, schema)


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    seg = segments(texts(spark, data_dir))
    return seg.where(f"sentences > 0 and confidence >= {SURE} and (stated is null or stated <> lang)").select("tbl", "doc_id", "lang").distinct()


def p4_segments(spark: SparkSession, data_dir: str) -> DataFrame:
    """(tbl, doc_id, start_char, end_char, lang, confidence): each text's segments with their language."""
    return segments(texts(spark, data_dir)).select("tbl", "doc_id", "start_char", "end_char", F.when(F.col("confidence") >= SURE, F.col("lang")).otherwise(OTHER).alias("lang"), F.round("confidence", 6).alias("confidence")).dropDuplicates(["tbl", "doc_id", "start_char"])
