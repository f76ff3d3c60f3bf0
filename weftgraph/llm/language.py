"""Language of every document and of every segment in one language.

A bidirectional gated recurrent network reads the bytes of each sentence and gives every position a distribution over the
languages; a sentence's is the mean over its positions. It is trained here by backpropagation through time, on
sentences of a bounded sample of labelled documents; sentences whose label the network then contradicts are left out of the last rounds, since labels are
partly wrong. Neighbouring sentences of one language make a segment.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window, functions as F

from weftgraph.llm import sentences
from weftgraph.llm.codepoints import slices
from weftgraph.session import ensure_checkpoint_dir

LANGS = ("ar", "de", "en", "es", "fr", "it", "ja", "nl", "pl", "pt", "ru", "sv", "zh")
# Other spellings of a label.
LABELS = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "pol": "pl", "rus": "ru", "swe": "sv", "jpn": "ja", "zho": "zh", "chi": "zh", "ara": "ar"}
#: Documents the network is trained on at most, and sentences of one language.
TRAIN_DOCUMENTS = 4_000
#: Of these, texts that the sentence splitter is fitted on at most.
TRAIN_SPLITTER = 1_500
TRAIN_SENTENCES = 3_000
HIDDEN = 32
#: Goes up when training changes, so that saved models aren't taken for new ones.
VERSION = 2
STEPS = 96
MARKUP = re.compile(r"<[^<>]*>|\[[^\[\]]*\]|\{[^{}]*\}|https?://\S+|www\.\S+|\S*[_@#/\\=|]\S*|\([^()\w]*[\d.,]+[^()\w]*\)|\d+")
WORD = re.compile(r"[^\W\d_]+")


def code(label: str | None) -> str | None:
    """The language that a label means, or None."""
    x = (label or "").strip().lower().split("-")[0].split("_")[0]
    x = LABELS.get(x, x)
    return x if x in LANGS else None


SPEAKER = re.compile(r"^\W*(?:[^\W\d_a-zß-öø-ÿ][\w'’-]*\s+){0,4}[^\W\d_a-zß-öø-ÿ][\w'’-]*:\s")


def content(unit: str) -> str:
    """The words of a sentence in lower case, without markup, numbers and a speaker's name; '' if they can't tell a language (names, single words)."""
    s = MARKUP.sub(" ", unit)
    s = SPEAKER.sub(" ", s) if ":" in s else s
    words = [w for w in WORD.findall(s) if len(w) <= 40 or not (w[0].islower() or w[0].isupper())]  # no word is longer
    low = sum(w[0].islower() for w in words)
    plain = sum(len(w) for w in words if not (w[0].islower() or w[0].isupper()))
    shouted = len(words) > 3 and not any(w[-1].islower() for w in words)
    if low < 2 and plain < 4 and not shouted:
        return ""
    return " ".join(words).lower()


@dataclass
class Network:
    """Both directions stacked: input table (2, 256, 3H), recurrent (2, H, 3H), bias (2, 3H); output (2H, L)."""

    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    o: np.ndarray
    c: np.ndarray

    def forward(self, seq: np.ndarray, keep: bool = False):
        """Hidden states (2, T, B, H) of byte sequences (B, T), the second direction read backwards; with what BPTT needs."""
        t, n, h = seq.shape[1], seq.shape[0], self.u.shape[1]
        out = np.zeros((2, t, n, h), np.float32)
        memo = []
        for d in range(2):
            s = np.zeros((n, h), np.float32)
            table = self.x[d] + self.b[d]
            ud = self.u[d]
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                a = table[seq[:, i]]
                g = s @ ud[:, : 2 * h]
                g += a[:, : 2 * h]
                g *= 0.5
                np.tanh(g, out=g)
                g += 1
                g *= 0.5
                r, z = g[:, :h], g[:, h:]
                rs = r * s
                k = rs @ ud[:, 2 * h :]
                k += a[:, 2 * h :]
                np.tanh(k, out=k)
                new = k + z * (s - k)
                if keep:
                    memo.append((d, i, s, r, z, k, rs))
                out[d, i] = s = new
        return (out, memo) if keep else out

    def position_probabilities(self, seq: np.ndarray) -> np.ndarray:
        """(B, T, L)."""
        h = self.forward(seq)
        half = self.u.shape[1]
        z = h[0] @ self.o[:half] + h[1] @ self.o[half:] + self.c
        z -= z.max(axis=2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=2, keepdims=True)
        return z.transpose(1, 0, 2)


def _new(rng: np.random.Generator) -> Network:
    h, n = HIDDEN, len(LANGS)
    f = lambda *s, k: rng.normal(0, k, s).astype(np.float32)
    return Network(f(2, 256, 3 * h, k=0.3), f(2, h, 3 * h, k=1 / np.sqrt(h)), np.zeros((2, 3 * h), np.float32), f(2 * h, n, k=0.15), np.zeros(n, np.float32))


def gradients(net: Network, seq: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over positions (mask) against one label a sequence, and its gradients, by BPTT."""
    hid, memo = net.forward(seq, True)
    h, (n, t) = HIDDEN, seq.shape
    z = hid[0] @ net.o[:h] + hid[1] @ net.o[h:] + net.c
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    m = mask.T[:, :, None].astype(np.float32)
    total = m.sum()
    loss = float(-(np.log(p[:, np.arange(n), y] + 1e-9) * m[:, :, 0]).sum() / total)
    p[:, np.arange(n), y] -= 1
    p *= m / total
    go = np.concatenate([np.einsum("tbh,tbl->hl", hid[d], p) for d in range(2)])
    gc = p.sum(axis=(0, 1))
    dh = [p @ net.o[:h].T, p @ net.o[h:].T]
    gx, gu, gb = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros_like(net.b)
    carry = np.zeros((n, h), np.float32)
    last = None
    das = np.zeros((2, t, n, 3 * h), np.float32)
    for d, i, s, r, zt, k, rs in reversed(memo):
        if d != last:
            carry = np.zeros((n, h), np.float32)
            last = d
        e = dh[d][i] + carry
        dk = e * (1 - zt) * (1 - k * k)
        dz = e * (s - k) * zt * (1 - zt)
        drs = dk @ net.u[d][:, 2 * h :].T
        dr = drs * s * r * (1 - r)
        da = np.concatenate([dr, dz, dk], axis=1)
        carry = e * zt + drs * r + da[:, : 2 * h] @ net.u[d][:, : 2 * h].T
        gu[d][:, : 2 * h] += s.T @ da[:, : 2 * h]
        gu[d][:, 2 * h :] += rs.T @ dk
        gb[d] += da.sum(0)
        das[d, i] = da
    hot = (np.arange(256)[:, None] == seq.T.ravel()[None, :]).astype(np.float32)
    for d in range(2):
        gx[d] = hot @ das[d].reshape(t * n, 3 * h)
    return loss, [gx, gu, gb, go, gc]


def pad(texts: list[bytes], steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, mask, text number): texts cut into windows of ``steps`` bytes, the last one padded with spaces."""
    own = np.concatenate([np.zeros(0, np.int64), *(np.full(-(-len(t) // steps), i) for i, t in enumerate(texts))])
    size = [-(-len(t) // steps) * steps for t in texts]
    flat = np.frombuffer(b"".join(t.ljust(z, b" ") for t, z in zip(texts, size)), np.uint8).reshape(-1, steps)
    mask = np.frombuffer(b"".join(b"\1" * len(t) + b"\0" * (z - len(t)) for t, z in zip(texts, size)), np.uint8).reshape(-1, steps)
    return flat, mask, own.astype(np.int64)


def train(pairs: list[tuple[str, str]], rounds: int = 600, seed: int = 5) -> Network:
    """The network from (sentence, language) pairs, of which some labels may be wrong."""
    rng = np.random.default_rng(seed)
    net = _new(rng)
    by: dict[int, list[bytes]] = {}
    for s, l in pairs:
        if x := content(s):
            by.setdefault(LANGS.index(l), []).append(x.encode("utf-8", "ignore"))
    by = {k: v[:TRAIN_SENTENCES] for k, v in by.items()}
    if not by:
        return net
    w = [net.x, net.u, net.b, net.o, net.c]
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    used = by
    langs = sorted(by)
    for t in range(1, rounds + 1):
        if t == rounds // 2:
            used = {}
            for k, texts in by.items():
                p = unit_probabilities(net, texts)
                good = [x for x, q in zip(texts, p) if q[k] > 0.35 or q.argmax() == k]
                used[k] = good if len(good) >= max(1, len(texts) // 5) else texts
        size = np.sqrt([len(used[k]) for k in langs])
        ys = rng.choice(langs, 96, p=size / size.sum())
        seqs = []
        for k in ys:
            s = used[k][rng.integers(len(used[k]))]
            at = int(rng.integers(max(1, len(s) - 40)))
            seqs.append(s[at : at + 64])
        flat, mask, _ = pad(seqs, 64)
        _, g = gradients(net, flat, mask, np.array(ys))
        scale = min(1.0, 1.0 / (1e-9 + np.sqrt(sum(float((a * a).sum()) for a in g))))
        rate = 0.012 * (1 - t / rounds) + 0.0008
        for i, a in enumerate(g):
            a = a * scale
            m[i] += 0.1 * (a - m[i])
            v[i] += 0.01 * (a * a - v[i])
            w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-7)
    return net


def unit_probabilities(net: Network, texts: list[bytes]) -> np.ndarray:
    """(n, L): mean position probabilities of each text, every byte of it read; of an empty text all zero."""
    out = np.zeros((len(texts), len(LANGS)))
    count = np.zeros(len(texts))
    # short texts in short windows, long ones in windows of STEPS
    size = np.array([len(t) for t in texts])
    for low, steps in ((0, 24), (24, 48), (48, STEPS)):
        pick = np.flatnonzero((size > low) & ((size <= steps) | (steps == STEPS)))
        if not len(pick):
            continue
        flat, mask, own = pad([texts[i] for i in pick], steps)
        for a in range(0, len(flat), 512):
            p = net.position_probabilities(flat[a : a + 512])
            k = mask[a : a + 512].astype(np.float32)
            who = pick[own[a : a + 512]]
            np.add.at(out, who, np.einsum("btl,bt->bl", p, k))
            np.add.at(count, who, k.sum(axis=1))
    return out / np.maximum(count, 1)[:, None]


#: What a change of language costs, in the scale of a sentence's weighted log-probabilities.
SWITCH = 4.0


def segments(spans: list[tuple[int, int]], probs: list[np.ndarray | None], weights: list[int]) -> list[tuple[int, int, str, float]]:
    """(start, end, language, confidence) of the runs of sentences in one language.

    A sentence that can't tell (None) joins the run it stands in. The runs are the best path over the sentences'
    log-probabilities, weighted by length, in which every change of language has a price.
    """
    told = [i for i, p in enumerate(probs) if p is not None]
    if not told:
        return []
    score, back = np.zeros(len(LANGS)), []
    for i in told:
        e = np.log(probs[i] + 0.01) * (min(weights[i], 100) / 25)
        best = int(score.argmax())
        stay = score >= score[best] - SWITCH
        back.append(np.where(stay, np.arange(len(LANGS)), best))
        score = np.where(stay, score, score[best] - SWITCH) + e
    path = [int(score.argmax())]
    for b in reversed(back[1:]):
        path.append(int(b[path[-1]]))
    path.reverse()
    out: list[list] = []
    at = dict(zip(told, path))
    for i, (a, b) in enumerate(spans):
        k = at.get(i)
        if k is None:
            if out:
                out[-1][1] = b
            continue
        if not out or out[-1][2] != k:
            out.append([a, b, k, 0.0, 0])
        out[-1][1] = b
        out[-1][3] += float(probs[i][k]) * weights[i]
        out[-1][4] += weights[i]
    out[0][0] = spans[0][0]
    return [(a, b, LANGS[k], s / max(1, n)) for a, b, k, s, n in out]


def _label(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, net = sentences.Scorer(model.value[0]), model.value[1]
        for batch in batches:
            for b in slices(batch, "text", 400_000):
                texts = b.column("text").to_pylist()
                docs = [sentences.spans(x, w) for x in texts]
                flat = [content(x[i:j]).encode("utf-8", "ignore") for x, d in zip(texts, docs) for i, j in d]
                number: dict[bytes, int] = {}
                own = [number.setdefault(t, len(number)) for t in flat]  # a sentence that stands there again is read once
                p = unit_probabilities(net, list(number))
                rows: list[tuple] = []
                ends = [0]
                at = 0
                for d in docs:
                    part = range(at, at + len(d))
                    at += len(d)
                    rows += segments(d, [p[own[i]] if flat[i] else None for i in part], [len(flat[i]) for i in part])
                    ends.append(len(rows))
                cols = list(zip(*rows)) if rows else [[]] * 4
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
                segs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["seg_start", "seg_end", "lang", "confidence"])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), segs)], names=["doc_id", "h", "segs"])

    return run


def training_rows(docs: DataFrame) -> list[tuple[str | None, str]]:
    """(language, text) of a sample of labelled documents chosen by hash, as many of every language."""
    d = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text").between(1, sentences.LONGEST_TRAINING))).select("lang", "text", F.xxhash64("text").alias("h"))
    per = TRAIN_DOCUMENTS // len(LANGS)
    rows = d.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).filter(F.col("rn") <= per).orderBy("h", "lang", "text").limit(4 * TRAIN_DOCUMENTS).collect()
    return [(code(r.lang), r.text) for r in rows]


def fit(rows: list[tuple[str | None, str]]) -> tuple[np.ndarray, Network]:
    """Weights of the sentence splitter and the network, from (language, text) rows."""
    w = sentences.fit([t for _, t in rows[:TRAIN_SPLITTER]])
    score = sentences.Scorer(w)
    return w, train([(t[i:j], l) for l, t in rows if l for i, j in sentences.spans(t, score)])


def fitted(docs: DataFrame) -> tuple[np.ndarray, Network]:
    """``fit`` on the documents' sample; a model is saved in the shared folder under the hash of its sample and parameters, and read there the next time."""
    spark = docs.sparkSession
    rows = training_rows(docs)
    name = xxhash.xxh3_128_hexdigest(repr((rows, TRAIN_SPLITTER, TRAIN_SENTENCES, HIDDEN, LANGS, VERSION)).encode("utf-8", "surrogatepass"))
    path = f"{ensure_checkpoint_dir(spark)}/language-{name}.parquet"
    try:
        return pickle.loads(spark.read.schema("model binary").parquet(path).first().model)
    except (AnalysisException, AttributeError):  # not there, or not written whole
        model = fit(rows)
    spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
    return model


def label_segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg_no, seg_start, seg_end, lang, confidence: every segment of every document.

    Documents with a null id, a null or blank text, or nothing that tells a language have none; ids should be unique (of different texts the one of the smallest hash counts). Extra columns are ignored.
    Texts are labelled where they are read; only segments travel.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fitted(docs))
    d = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.trim("text") != "")).select("doc_id", "text", F.xxhash64("text").alias("h"))
    seen = d.mapInArrow(_label(model), "doc_id long, h long, segs array<struct<seg_start:long,seg_end:long,lang:string,confidence:double>>")
    once = seen.groupBy("doc_id").agg(F.min_by("segs", "h").alias("segs"))
    return once.select("doc_id", F.posexplode("segs").alias("at", "s")).select("doc_id", (F.col("at") + 1).cast("long").alias("seg_no"), "s.*")


def wrong_labels(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, seg_no, lang: segments of documents that have several, or whose label isn't exactly the only one's code."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("lang").alias("only"))
    bad = docs.select("doc_id", F.col("lang").alias("label")).join(n, "doc_id").filter((F.col("n") > 1) | ~F.col("label").eqNullSafe(F.col("only"))).select("doc_id").distinct()
    return found.join(bad, "doc_id").select("doc_id", "seg_no", "lang")
