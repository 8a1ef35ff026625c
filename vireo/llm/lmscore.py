"""Language-model scores: a causal self-attention model in numpy on subword ids, beside a word-unigram base.

Words (ASCII case folded, split at ASCII white space) are cut by a public byte-level BPE vocabulary, each with a leading space, and
an end mark closes the text. The query's model (``every``) reads and predicts every subword by attention:

- The network predicts each subword, or the end mark, from the subwords before it: 253 outcomes for the most frequent ones, one for
  the end mark, and two tails, of subwords that open a word (those that begin with its leading space) and of those that go on with
  one, within which ids have their smoothed frequency. That a word ends is told by what opens after it, so no mark stands for that:
  the chance that something opens is a factor of the word before, and what opens is scored given that something does.
- Groups, windows and training are as below, over subwords: 16 to 31 subwords before each.

Without ``every``, a smaller model: a word's probability is that of its first subword, by attention, times that of its spelling:

- The network predicts each word's first subword (or the end mark) from the words before it, which it knows by their first
  subwords: 254 outcomes for the most frequent ones, one for the end mark, and a tail within which ids have their smoothed
  frequency. Outcomes lie in GROUPS groups, and the softmax is one over groups times one within the group. Sequences are read
  in windows of 2 * BLOCK words that overlap by half: a block of BLOCK queries attends, under a causal mask, to its own block
  and the one before, so that each word is scored once and with BLOCK to 2 * BLOCK - 1 predecessors (where the text has them).
- The spelling goes from each subword of the word to the next, or to the word's end, by a smoothed table of how often that is
  met in training; it depends on the word alone and is worked out once for each different word.

Learning, from training documents only (crc32 of doc_id as text, mod 7, is not 2), covers every word of every text, at any size:
word and subword counts; the spelling table (without ``every``); how often each outcome follows each, which the network's logits start from and
which stays fixed; and the attention, fitted by federated averaging over consecutive windows that cover every training text
whole, so that each subword (or word, without ``every``) and end mark is a target once. Windows are written as segments of SEGMENT targets, which are dealt to
ROUNDS rounds, and within a round to learners, which see their windows once; a task is one learner, or several in turn where there
are many. Weights (some 70 kB) are averaged over learners between rounds. So what is gathered grows with the corpus, and what the
driver holds doesn't.

With ``every``, each text, held out or not, is cut into subwords once: its ids are written (two bytes each) and read for scoring.
Where words end is told by the ids that open one, and a word's 64-bit hash is one of its ids.

The model of a word is an even mixture, as in cache and pointer models: the probability above, and the word's relative frequency
in training (nothing if it isn't met there, so the whole still sums to one at most). attention_score is the first part alone.

The mixture needs each word's exact count. The FREQUENT most frequent words go to every task (8 MB at most, whatever the input);
the others are joined by a 64-bit word hash, with their probabilities beside it, and their share of the score is added.

Defined cases: a null text is empty: one token, the end; a null doc_id counts as training (its crc32 is null) and is scored like others;
repeated rows train and are scored each; without training documents all counts are 0 and scores follow the smoothing alone; an
empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import keep_freed_memory, lower_words, materialize, mix, one_blas_thread, read_table, small_batches, text_bytes, word_hashes

VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")  # a parameter of every function here
N_IDS = 50_257
STOP, LAST = N_IDS - 1, 0xFFFF  # the id that the vocabulary leaves free stands for the end mark; no id is the last of these
CLASSES, WIDTH, BLOCK = 256, 16, 16
GROUPS = 16
SIZE = CLASSES // GROUPS  # outcomes of a group, a power of two
SEGMENT = 64 * BLOCK  # targets of a training row
END, TAIL, PAD = CLASSES - 2, CLASSES - 1, CLASSES
SPELLED = 1024  # classes of subwords in the spelling table, the last one for all the rest; column SPELLED is the word's end
FREQUENT = 1 << 19
ROUNDS, BATCH, TASK_WINDOWS, MAX_TASKS = 3, 256, 16_384, 4096
TASK_LEARNERS = 8  # learners of a task
RATE = 0.01
FLUSH = 400_000  # distinct words that a task holds
CHUNK = 256  # blocks that are scored together
TOGETHER = 1 << 16  # bytes of texts whose words are looked up together, few enough for the processor's cache
FOLDS, HELD_OUT = 7, 2

_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # a fixed value: the vocabulary's word pattern

_OTHER_SPACE = re.compile(r"[^\S ]")  # what that pattern takes as white space, the space aside, and some more


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def openers(ranks: dict[bytes, int]) -> np.ndarray:
    """Which ids open a word: those that begin with a space. Each word's first does, and no other of it."""
    out = np.zeros(N_IDS, bool)
    for token, k in ranks.items():
        out[k] = token[:1] == b" "
    return out


class Subwords:
    """Ids of words, each with a leading space."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import tiktoken

        ranks = ranks_of(path)
        self.encoding = tiktoken.Encoding("words", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.opens = openers(ranks)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each word has."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        text = " " + b" ".join(words).decode()
        if _OTHER_SPACE.search(text):  # words with other white space in them: one by one, as what they are cut into must not depend on their neighbours
            apart = [_OTHER_SPACE.search(w.decode()) is not None for w in words]
            each = [self.encoding.encode_ordinary(" " + w.decode()) if a else None for w, a in zip(words, apart, strict=True)]
            flat, size = self.encode([w for w, a in zip(words, apart, strict=True) if not a])
            sizes = np.array([len(e) if e else 0 for e in each])
            sizes[sizes == 0] = size
            out = np.zeros(int(sizes.sum()), np.int64)
            own = np.repeat(apart, sizes)
            out[own], out[~own] = [i for e in each if e for i in e], flat
            return out, sizes
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))


@functools.lru_cache(maxsize=2)
def subwords(path: str) -> Subwords:
    """One vocabulary for all tasks of a process."""
    return Subwords(path)


def word_keys(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of so many subword ids each, the same in every process. Different words have different ids."""
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    return np.add.reduceat(mix((ids + 1 | place << 16).astype(np.uint64)), starts) if len(starts) else np.zeros(0, np.uint64)


def _runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin and are as long as given, behind each other."""
    ends = np.cumsum(size)
    return np.repeat(begin - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


# --- counts --------------------------------------------------------------------------------------------------------------


def _tail_share(counts: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """log10 of the smoothed share of each id of a tail within it; 0 for the other ids."""
    n = np.where(tail, counts, 0)
    return np.where(tail, np.log10((n + 1) / (n.sum() + max(int(tail.sum()), 1))), 0.0)


class Classes:
    """Which ids have an outcome, or a row of the spelling table, of their own, and the share of the others within the tail."""

    def __init__(self, ids: np.ndarray, first: np.ndarray) -> None:
        """How often each subword id occurs in training, and how often as a word's first."""
        n = first.copy()
        n[N_IDS - 1] = -1
        head = np.argsort(-n, kind="stable")[: CLASSES - 2]
        self.of = np.full(N_IDS, TAIL, np.int64)
        self.of[head] = np.arange(CLASSES - 2)
        self.of[N_IDS - 1] = END
        self.inside = _tail_share(first, self.of == TAIL)
        total = np.bincount(self.of, weights=first, minlength=CLASSES)
        self.prior = np.log((total + 1) / (total.sum() + CLASSES))
        self.spelled = np.full(N_IDS, SPELLED - 1, np.int64)
        self.spelled[np.argsort(-ids, kind="stable")[: SPELLED - 1]] = np.arange(SPELLED - 1)
        self.later = _tail_share(ids - np.where(np.arange(N_IDS) < N_IDS - 1, first, 0), self.spelled == SPELLED - 1)

    def places(self, steps: np.ndarray) -> np.ndarray:
        """The place of steps (see steps_of()) in the spelling table."""
        after = steps & 0xFFFF
        return self.spelled[steps >> 16] * (SPELLED + 1) + np.where(after == LAST, SPELLED, self.spelled[np.minimum(after, N_IDS - 1)])


class Outcomes:
    """Outcomes of all subwords. The groups from ``opening`` on hold what a word may be followed by: ids that open the next one, their tail, and the end mark; the groups before hold ids that go on with a word, and theirs."""

    def __init__(self, ids: np.ndarray, opens: np.ndarray) -> None:
        """How often each id occurs in training, the end mark's at STOP, and which ids open a word."""
        n = ids.copy()
        n[STOP] = -1
        order = np.argsort(-n, kind="stable")
        self.opening = int(np.clip(round(GROUPS * (1 - opens[order[: CLASSES - 3]].mean())), 1, GROUPS - 1))
        later = self.opening * SIZE - 1
        self.of = np.where(opens, TAIL, later)
        self.of[order[opens[order]][: END - later - 1]] = np.arange(later + 1, END)
        self.of[order[~opens[order]][:later]] = np.arange(later)
        self.of[STOP] = END
        self.inside = _tail_share(ids, self.of == TAIL) + _tail_share(ids, self.of == later)
        total = np.bincount(self.of, weights=ids, minlength=CLASSES)
        self.prior = np.log((total + 1) / (total.sum() + CLASSES))


def steps_of(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For words of so many ids each: from each id to the next one, or to the word's end, both in one number."""
    after = np.append(ids[1:], LAST)
    after[np.cumsum(sizes) - 1] = LAST
    return ids << 16 | after


def spelling(pairs: np.ndarray) -> np.ndarray:
    """log10 of the probability of each step, from how often it is met; rarely met subwords lean on the steps of all."""
    n = pairs.reshape(SPELLED, SPELLED + 1)
    whole = n.sum(axis=0) + 1.0
    whole /= whole.sum()
    return np.log10((n + 20 * whole) / (n.sum(axis=1, keepdims=True) + 20)).ravel()


# --- the network ---------------------------------------------------------------------------------------------------------


def initial() -> dict[str, np.ndarray]:
    """Weights to start from: keys and values, queries and residuals by class, biases by distance, and the way out."""
    rng = np.random.Generator(np.random.PCG64(5))
    s = 0.3 / np.sqrt(WIDTH)
    side = lambda x, y: np.concatenate([rng.normal(0, x, (CLASSES + 1, WIDTH)), rng.normal(0, y, (CLASSES + 1, WIDTH))], axis=1)
    w = {"kv": side(s, 0.3), "qr": side(s, 0.1), "near": np.zeros(2 * BLOCK), "a": rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, WIDTH)), "b": np.zeros(WIDTH)}
    w |= {"out1": rng.normal(0, 0.05, (WIDTH, GROUPS)), "out2": rng.normal(0, 0.05, (GROUPS, WIDTH, SIZE))}
    return {k: x.astype(np.float32) for k, x in w.items()}


def follow(prior: np.ndarray, pairs: np.ndarray) -> dict[str, np.ndarray]:
    """Logits of groups and of outcomes after each class, from how often each outcome follows each: what the network adds to."""
    unigram = np.exp(prior)
    p = (pairs + 20 * unigram[None, :]) / (pairs.sum(axis=1, keepdims=True) + 20)
    p = np.concatenate([p, unigram[None]])
    by_group = p.reshape(CLASSES + 1, GROUPS, SIZE)
    return {"pair1": np.log(by_group.sum(axis=2)).astype(np.float32), "pair2": np.log(by_group).reshape(-1, SIZE).astype(np.float32)}


#: Distance of each key from each query, and which are not later.
_DISTANCE = (BLOCK + np.arange(BLOCK))[:, None] - np.arange(2 * BLOCK)[None, :]
_CAUSAL = _DISTANCE >= 0
_DISTANCE = np.where(_CAUSAL, _DISTANCE, 0)
_FAR = np.float32(-1e9)


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last, short axis: a product is many times as fast as NumPy's own sum there."""
    return (x.reshape(-1, x.shape[-1]) @ np.ones(x.shape[-1], x.dtype)).reshape(x.shape[:-1])


def by_class(w: dict) -> tuple:
    """What hidden() looks up: exponentials of what each class of query gives each class of key (0 for padding), and those of distances, of which the product is a weight; values led through ``a``; and what is added to them.

    There are far fewer pairs of classes than pairs of places in a batch, so products and exponentials are worked out by class.
    """
    pairs = w["qr"][:, :WIDTH] @ w["kv"][:, :WIDTH].T
    near = np.where(_CAUSAL, w["near"][_DISTANCE], _FAR)
    steep = pairs.max() + near.max() > 30
    pairs[:, PAD] = _FAR
    if not steep:
        pairs, near = np.exp(pairs, out=pairs), np.exp(near)
    return pairs, near, w["kv"][:, WIDTH:] @ w["a"], w["qr"][:, WIDTH:] + w["b"], steep


def hidden(w: dict, keys: np.ndarray, train: bool = False) -> tuple:
    """keys: (blocks, 2 * BLOCK) input classes, the second half being the queries: hidden state of each query, and what training needs. w may hold by_class() of its weights."""
    asked = keys[:, BLOCK:]
    pairs, near, values, rest, steep = w["by_class"] if "by_class" in w else by_class(w)
    at = np.repeat((asked * (CLASSES + 1)).ravel(), 2 * BLOCK).reshape(*asked.shape, -1)
    at += keys[:, None, :]
    e = pairs.take(at, mode="clip")  # faster than with bounds looked at
    if steep:  # logarithms yet
        e += near
        np.exp(np.minimum(e, 30, out=e), out=e)
    else:
        e *= near
    total = _sums(e)[:, :, None] + np.float32(1e-20)
    v = values.take(keys, axis=0)
    if train:
        e /= total
    attended = e @ v
    if not train:
        attended /= total
    h = rest.take(asked, axis=0)
    h += attended
    h = h.reshape(-1, WIDTH)
    return np.tanh(h, out=h), (asked, at, v, e, attended) if train else asked


@functools.lru_cache(maxsize=4)
def _starts(rows: int) -> np.ndarray:
    """Where rows of logits of groups, or within one, begin; to be read only."""
    return np.arange(0, rows * SIZE, SIZE)


def _by_group(w: dict, fixed: dict, h: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
    """Targets in the order of their groups, the borders of groups, and hidden states and logits within the group in that order."""
    group = (y // SIZE).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(GROUPS + 1))
    hs = h.take(order, axis=0)
    z = fixed["pair2"].take((x * GROUPS + group)[order], axis=0)
    own, ends = np.empty_like(z), ends.tolist()
    for lo, hi, out in zip(ends, ends[1:], w["out2"]):
        np.matmul(hs[lo:hi], out, out=own[lo:hi])
    z += own
    return order, ends, hs, z


def log_probabilities(w: dict, fixed: dict, keys: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each target class."""
    return log_probabilities_and_openings(w, fixed, keys, targets, 0)[0]


def log_probabilities_and_openings(w: dict, fixed: dict, keys: np.ndarray, targets: np.ndarray, opening: int) -> tuple[np.ndarray, np.ndarray]:
    """As log_probabilities(), and the logarithm of the probability of all groups from ``opening`` on, where each target is asked for."""
    h, asked = hidden(w, keys)
    x, y = asked.ravel(), targets.ravel()
    z = h @ w["out1"]
    z += fixed["pair1"].take(x, axis=0)
    out = z.take(_starts(len(z)) + y // SIZE)
    sides = np.ones((GROUPS, 2), z.dtype)
    sides[:opening, 1] = 0
    total, opened = np.log(np.exp(z, out=z) @ sides).T
    out -= total
    opened = opened - total
    order, _, _, z = _by_group(w, fixed, h, x, y)
    inner = z.take(_starts(len(z)) + (y[order] & SIZE - 1))
    inner -= np.log(_sums(np.exp(z, out=z)))
    out[order] += inner
    return out.reshape(targets.shape), opened.reshape(targets.shape)


def _inverse(order: np.ndarray) -> np.ndarray:
    out = np.empty_like(order)
    out[order] = np.arange(len(order))
    return out


def _summed(at: np.ndarray, rows: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Rows added up by class; two columns at a time, as complex numbers, which takes half as many of NumPy's steps."""
    at = at.ravel()
    order = np.argsort(at.astype(np.uint16), kind="stable")
    times = np.bincount(at, minlength=len(like))
    own = np.flatnonzero(times)
    starts = (np.cumsum(times) - times)[own]
    rows = rows.reshape(len(at), -1).take(order, axis=0)
    out = np.zeros_like(like)
    out[own] = np.add.reduceat(rows.view(np.result_type(rows, np.complex64)), starts, axis=0).view(rows.dtype)
    return out


def _less_target(z: np.ndarray, y: np.ndarray, weight: np.ndarray, loss: bool) -> tuple[np.ndarray, float]:
    """Softmax of logits less one at the target, weighted; and, if asked for, the weighted sum of the targets' log probabilities."""
    at = _starts(len(z)) + y
    own = float(z.ravel()[at] @ weight) if loss else 0.0
    p = np.exp(z, out=z)
    total = _sums(p)
    p *= (weight / total)[:, None]
    p.reshape(-1)[at] -= weight
    return p, own - float(np.log(total) @ weight) if loss else 0.0


def gradients(w: dict, fixed: dict, keys: np.ndarray, targets: np.ndarray, loss: bool = True) -> tuple[float, dict]:
    """Mean loss (0 unless asked for) and its gradients; targets may hold PAD where nothing is asked."""
    h, (asked, at, v, e, attended) = hidden(w, keys, True)
    x, y = asked.ravel(), targets.ravel()
    use = y != PAD
    weight = use / np.float32(max(int(use.sum()), 1))
    y = np.where(use, y, 0)
    p, first = _less_target(h @ w["out1"] + fixed["pair1"].take(x, axis=0), y // SIZE, weight, loss)
    g = {"out1": h.T @ p}
    back = p @ w["out1"].T
    order, ends, hs, z = _by_group(w, fixed, h, x, y)
    p, second = _less_target(z, y[order] & SIZE - 1, weight[order], loss)
    g["out2"] = np.zeros_like(w["out2"])
    inner = np.empty_like(hs)
    for c, part in enumerate(map(slice, ends, ends[1:])):
        np.matmul(hs[part].T, p[part], out=g["out2"][c])
        np.matmul(p[part], w["out2"][c].T, out=inner[part])
    back += inner.take(_inverse(order), axis=0)
    np.multiply(h, h, out=h)
    pre = np.multiply(back, np.subtract(1, h, out=h), out=back)
    g["b"] = np.ones(len(pre), pre.dtype) @ pre
    da = pre.reshape(attended.shape)
    de = da @ v.transpose(0, 2, 1)
    de -= _sums(da * attended)[:, :, None]  # what de sums to under e
    ds = np.multiply(de, e, out=de)
    g["near"] = np.bincount(_DISTANCE.ravel(), weights=np.where(_CAUSAL, ds.sum(axis=0), 0).ravel(), minlength=2 * BLOCK).astype(np.float32)
    q, k, v = w["qr"][:, :WIDTH], w["kv"][:, :WIDTH], w["kv"][:, WIDTH:]
    pairs = np.zeros((CLASSES + 1, CLASSES + 1), ds.dtype)
    np.add.at(pairs.reshape(-1), at.ravel(), ds.ravel())  # in its own precision: bincount() turns all into float64 first
    values = _summed(keys, e.transpose(0, 2, 1) @ da, v)
    g["a"] = v.T @ values
    g["kv"] = np.concatenate([pairs.T @ q, values @ w["a"].T], axis=1)
    g["qr"] = np.concatenate([pairs @ k, _summed(asked, pre, q)], axis=1)
    return -(first + second), g


def train(w: dict, fixed: dict, windows: np.ndarray, seed: int) -> dict:
    """Adam over windows, rows of 2 * BLOCK inputs and BLOCK targets, each once in a seeded order."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(w)
    flat = np.concatenate([w[k].ravel() for k in names])  # all weights in a row, so that a step is few operations
    w = {k: x.reshape(w[k].shape) for k, x in zip(names, np.split(flat, np.cumsum([w[k].size for k in names])[:-1]), strict=True)}
    m1, m2 = np.zeros_like(flat), np.zeros_like(flat)
    order = rng.permutation(len(windows))
    total = -(-len(windows) // BATCH)
    for step in range(1, total + 1):
        part = windows[order[(step - 1) * BATCH : step * BATCH]].astype(np.int64)
        _, g = gradients(w, fixed, part[:, : 2 * BLOCK], part[:, 2 * BLOCK :], False)
        rate = RATE * (1 - 0.9 * step / total)
        x = np.concatenate([g[k].ravel() for k in names])
        m1 += 0.1 * (x - m1)
        m2 += 0.01 * (x * x - m2)
        flat -= rate / (1 - 0.9**step) * m1 / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
    return w


def _row(w: dict) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in sorted(w)]).astype(np.float64)


def _unpacked(data: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        n = like[k].size
        out[k] = data[at : at + n].reshape(like[k].shape).astype(np.float32)
        at += n
    return out


def segments_of(whole: np.ndarray) -> list[bytes]:
    """A text's first ids between end marks, as rows of SEGMENT targets: how many inputs before the first one's (0 or BLOCK), then the ids."""
    x = whole.astype("<u2")
    out = []
    for lo in range(0, len(x) - 1, SEGMENT):
        before = min(BLOCK, lo)
        out.append(bytes([before]) + x[lo - before : lo + SEGMENT + 1].tobytes())
    return out


def outcomes_of(segment: bytes, of: np.ndarray) -> np.ndarray:
    return of[np.frombuffer(segment, "<u2", offset=1)]


def windows_of(segment: bytes, of: np.ndarray) -> np.ndarray:
    """The training windows of a segment: rows of 2 * BLOCK inputs and BLOCK targets, one for each block of targets. of: the outcome of each id."""
    before, x = segment[0], outcomes_of(segment, of)
    n = len(x) - 1 - before
    k = -(-n // BLOCK)
    inputs, targets = np.full((k + 1) * BLOCK, PAD, np.uint16), np.full(k * BLOCK, PAD, np.uint16)
    inputs[BLOCK - before : BLOCK + n] = x[:-1]
    targets[:n] = x[before + 1 :]
    rows = inputs.reshape(-1, BLOCK)
    return np.concatenate([rows[:-1], rows[1:], targets.reshape(-1, BLOCK)], axis=1)


class Model:
    """What scoring needs where attention is over first subwords; some 9 MB of weights and tables, sent to every task."""

    def __init__(self, weights: dict, fixed: dict, classes: Classes, steps: np.ndarray) -> None:
        self.weights, self.fixed, self.classes, self.steps = weights, fixed, classes, steps.astype(np.float32)

    def spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The outcomes of words that attention is asked for, in order, and how many each word has (here its first subword's); and log10 of the probability of the word once they are given."""
        c = self.classes
        starts = np.cumsum(sizes) - sizes
        each = self.steps[c.places(steps_of(ids, sizes))].astype(np.float64) + c.later[ids]
        each[starts] += c.inside[ids[starts]] - c.later[ids[starts]]
        return c.of[ids[starts]], np.ones(len(starts), np.int64), np.add.reduceat(each, starts) if len(starts) else each

    def scores(self, outcomes: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each word's outcomes, and of each text's end mark; outcomes of all texts in order, how many each word has, and words of each text."""
        out, _, place, ends = self._placed(outcomes, sizes, 0)
        return out[place], out[ends]

    def _placed(self, outcomes: np.ndarray, sizes: np.ndarray, opening: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities, and those of groups from ``opening`` on, by place; the places of all outcomes, sizes of them a text, and of each text's end mark."""
        blocks = -(-(sizes + 1) // BLOCK)
        rows = np.concatenate([[0], np.cumsum(blocks + 1)])
        flat = np.full(int(rows[-1]) * BLOCK, PAD, np.int64)
        target = np.full(len(flat), END, np.int64)
        begin = rows[:-1] * BLOCK + BLOCK  # where a text's inputs begin: a row of padding comes first
        place = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(len(outcomes))
        flat[begin] = END
        flat[place + 1] = outcomes
        target[place] = outcomes
        by_row = flat.reshape(-1, BLOCK)
        target = target.reshape(-1, BLOCK)
        own = np.delete(np.arange(len(by_row)), rows[:-1])
        out, opened = (np.zeros(by_row.shape, np.float32) for _ in range(2))
        weights = self.weights | {"by_class": by_class(self.weights)}
        for lo in range(0, len(own), CHUNK):
            r = own[lo : lo + CHUNK]
            out[r], opened[r] = log_probabilities_and_openings(weights, self.fixed, np.concatenate([by_row[r - 1], by_row[r]], axis=1), target[r], opening)
        out, opened = (x.ravel().astype(np.float64) / np.log(10) for x in (out, opened))
        return out, opened, place, begin + sizes


class SubwordModel(Model):
    """What scoring needs where attention is over all subwords."""

    def __init__(self, weights: dict, fixed: dict, outcomes: Outcomes) -> None:
        self.weights, self.fixed, self.classes = weights, fixed, outcomes

    def spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum(sizes) - sizes
        return self.classes.of[ids], sizes, np.add.reduceat(self.classes.inside[ids], starts) if len(starts) else np.zeros(0)

    def scores(self, outcomes: np.ndarray, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """That a word ends is told by an opening outcome after it, so the chance of one is a factor of the word, and the outcome's own is taken given that there is one. So the words that may come, and the end, sum to one."""
        whole = np.append(0, np.cumsum(parts))
        ends = np.cumsum(sizes)
        out, opened, place, stops = self._placed(outcomes, whole[ends] - whole[ends - sizes], self.classes.opening)
        starts = whole[:-1]
        each = out[place]
        each[starts] -= opened[place[starts]]
        by_word = np.add.reduceat(each, starts) if len(starts) else each
        return by_word + opened[place[whole[1:] - 1] + 1], out[stops] - opened[stops]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


WORD, ID, FIRST, STEP, TEXT, WHOLE = range(6)  # kinds of what is read from texts


def fit(training: DataFrame, vocabulary: str = VOCABULARY, every: bool = False) -> tuple[Model, DataFrame]:
    """The model, and the counts (a written table: key, n) of all training words, from training texts (columns doc_id, and text as bytes). every: attention over all subwords."""
    return _learned(_seen(training.withColumn("held_out", F.lit(False)), vocabulary, every), vocabulary, every)


def _seen(rows: DataFrame, vocabulary: str, every: bool) -> DataFrame:
    """What one reading of texts gives, as a written table (see _read_rows())."""
    small_batches(rows.sparkSession)
    return materialize(rows.select("doc_id", "text", "held_out").mapInArrow(_read_rows(vocabulary, every), "kind byte, key long, n long, segment binary, whole binary"))


def _learned(seen: DataFrame, vocabulary: str, every: bool) -> tuple[Model, DataFrame]:
    counts = materialize(seen.filter(F.col("kind") == WORD).groupBy("key").agg(F.sum("n").alias("n")))
    ids, first = (np.zeros(N_IDS, np.int64) for _ in range(2))
    for r in seen.filter(F.col("kind").isin(ID, FIRST)).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():  # twice as many rows as the vocabulary has ids, at most
        (ids if r["kind"] == ID else first)[r["key"]] = r["n"]
    if every:
        ids[STOP] = first[STOP]
        classes = Outcomes(ids, openers(ranks_of(vocabulary)))
    else:
        classes = Classes(ids, first)
    segments = seen.filter(F.col("kind") == TEXT).select("segment", "key", "n")
    of = classes.of.astype(np.uint16)  # a quarter of the memory to go through, and a pair of outcomes is such a number too

    def pairs_of(batch: pa.RecordBatch) -> np.ndarray:
        own = [outcomes_of(x, of)[x[0] :] for x in batch.column(0).to_pylist()]
        return np.concatenate([x[:-1] * CLASSES + x[1:] for x in own])

    pairs = _table(segments.select("segment", "n"), CLASSES * CLASSES, lambda b: (pairs_of(b), None))
    steps = None if every else _table(seen.filter(F.col("kind") == STEP).select("key", "n"), SPELLED * (SPELLED + 1), lambda b: (classes.places(b.column(0).to_numpy()), b.column(1).to_numpy()))
    fixed = follow(classes.prior, pairs.reshape(CLASSES, CLASSES))
    n = segments.agg(F.sum("n")).first()[0] or 0
    weights = initial()
    learners = int(min(MAX_TASKS, max(2, n // (ROUNDS * TASK_WINDOWS))))
    for turn in range(ROUNDS if n else 0):
        weights = _average(_trained(segments.filter(F.col("key") % ROUNDS == turn), weights, fixed, of, learners, turn), weights)
    return SubwordModel(weights, fixed, classes) if every else Model(weights, fixed, classes, spelling(steps)), counts


def _table(rows: DataFrame, size: int, places) -> np.ndarray:
    """How often each place of a table is met; places: those of a batch, and how often each (once, if None). Tasks add up theirs, so as many rows as the table has places come to the driver, at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            if batch.num_rows:
                at, times = places(batch)
                total += np.bincount(at, weights=times, minlength=size).astype(np.int64)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["place", "n"])

    out = np.zeros(size)
    found = rows.mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    out[found["place"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def _read_rows(vocabulary: str, every: bool = False):
    """One reading of texts: of training texts, counts of words (by hash) and ids, and segments, with their keys and numbers of windows. every: segments are of all ids, and each text, held out or not, is given as its ids, two bytes each, beside its doc_id, in a column of their own, as segments are read several times; else segments are of first ids, and these and steps of spelling are counted too."""
    schema = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("n", pa.int64()), ("segment", pa.binary()), ("whole", pa.binary())])

    def counted(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key), pa.array(n), *[pa.nulls(len(key), pa.binary())] * 2], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        reader = _Reader(vocabulary, every)
        ends = 0
        for batch in batches:
            if reader.n > FLUSH:
                yield from (counted(*x) for x in reader.counts())
                reader.clear()
            found, keys, windows = [], [], []
            doc_ids, texts, held = (x.to_pylist() for x in batch.columns)
            learnt = [k for k, x in enumerate(held) if not x]
            asked = reader.asked(*reader.read([texts[k] for k in learnt]))
            for k, x in zip(learnt, asked, strict=True):
                ends += 1
                for place, data in enumerate(segments_of(np.concatenate([[STOP], x, [STOP]]))):
                    found.append(data)
                    keys.append(xxhash.xxh3_64_intdigest(f"{doc_ids[k]} {place} ".encode() + data) >> 1)  # copies in other documents are dealt elsewhere
                    windows.append(-(-((len(data) - 1) // 2 - 1 - data[0]) // BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), TEXT, np.int8)), pa.array(keys, pa.int64()), pa.array(windows, pa.int64()), pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], schema=schema)
            if every:
                others = [k for k, x in enumerate(held) if x]
                asked += reader.asked(*reader.look_up([texts[k] for k in others]))
                whole = pa.array([x.astype("<u2").tobytes() for x in asked], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(whole), WHOLE, np.int8)), pa.array([doc_ids[k] for k in learnt + others], pa.int64()), pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.binary()), whole], schema=schema)
        yield from (counted(*x) for x in reader.counts())
        if ends:
            yield counted(FIRST, np.array([STOP]), np.array([ends]))

    return run


def _trained(segments: DataFrame, weights: dict, fixed: dict, of: np.ndarray, learners: int, turn: int) -> DataFrame:
    """Weights after a round, summed by windows seen, and how many these are. Learners all start from the same weights, each with windows of its own; where there are many, a task is TASK_LEARNERS of them in turn, as starting a Python task takes a quarter of a learner's time."""
    each = TASK_LEARNERS if learners >= 8 * TASK_LEARNERS else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        remembered.cache_clear()  # texts are read by now
        w, total, step, summed, seen = weights, 0, 0, 0, 0
        held: list[np.ndarray] = []
        n, now = 0, 0

        def learn(w: dict) -> dict:
            return train(w, fixed, np.concatenate(held), 1000 * turn + step)

        def added() -> tuple[np.ndarray, int]:
            """The sums with those of the learner that ends."""
            last = learn(w) if held else w
            return (summed + _row(last) * (total + n), seen + total + n) if total + n else (summed, seen)

        for batch in batches:
            learner = batch.column(1).to_numpy()
            borders = [0, *(np.flatnonzero(np.diff(learner)) + 1).tolist(), len(learner)]
            for lo, hi in zip(borders, borders[1:]):
                if lo < hi and learner[lo] != now:
                    summed, seen = added()
                    w, total, step, held, n, now = weights, 0, 0, [], 0, learner[lo]
                found = [windows_of(x, of) for x in batch.column(0).slice(lo, hi - lo).to_pylist()]
                held, n = held + found, n + sum(map(len, found))
                if n >= 4 * TASK_WINDOWS:
                    w, total, step, held, n = learn(w), total + n, step + 1, [], 0
        summed, seen = added()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([summed.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["weights", "n"])

    dealt = segments.select("segment", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(each)).cast("int").alias("learner"), "key")
    dealt = dealt.repartition(learners // each, F.xxhash64("key")).sortWithinPartitions("learner", "key", "segment")
    return dealt.select("segment", "learner").mapInArrow(run, "weights binary, n long")


def _average(found: DataFrame, like: dict) -> dict:
    """Mean weights by windows seen, from sums, added up by up to 64 tasks before the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            for data, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(data, np.float64)
                total, n = x if total is None else total + x, n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["weights", "n"])

    rows = materialize(found).coalesce(64).mapInArrow(run, "weights binary, n long").collect()
    if not rows:
        return like
    return _unpacked(sum(np.frombuffer(r["weights"], np.float64) for r in rows) / sum(r["n"] for r in rows), like)


def _behind(held: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """held with more after its first n values; copied only when it must grow, and then to twice the size."""
    if n + len(more) > len(held):
        held = np.concatenate([held[:n], np.empty(n + 2 * len(more), held.dtype)])
    held[n : n + len(more)] = more
    return held


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """texts in order, as groups of up to TOGETHER bytes; a longer text is a group of its own."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


class Parts:
    """Values of words, some of each, behind each other."""

    def __init__(self) -> None:
        self.n, self.m, self.flat, self.size, self.begin = 0, 0, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Take in the values of more words."""
        self.flat = _behind(self.flat, self.m, flat)
        self.size, self.begin = _behind(self.size, self.n, sizes), _behind(self.begin, self.n, self.m + np.cumsum(sizes) - sizes)
        self.n, self.m = self.n + len(sizes), self.m + len(flat)

    def of(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of words in order, and how many each has."""
        size = self.size[w]
        return self.flat[_runs(self.begin[w], size)], size


class Numbers:
    """Numbers of 64-bit hashes, from 0 on as they are added."""

    def clear(self) -> None:
        self.n, self.own = 0, np.zeros(0, np.uint64)
        self._slots(20)

    def _slots(self, bits: int) -> None:
        """Empty slots, 2 ** bits of them: a word's number is in the slot that its hash begins with, or in one of the next."""
        self.bits, self.keys, self.numbers = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 where not met before."""
        at = self._home(h)
        out = self.numbers[at]
        rest = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        while len(rest):
            at[rest] = next_ = at[rest] + 1 & len(self.keys) - 1
            out[rest] = found = self.numbers[next_]
            rest = rest[(found >= 0) & (self.keys[next_] != h[rest])]
        return out.astype(np.int64)

    def _put(self, h: np.ndarray, n: int) -> None:
        """Give different new words the numbers from n on; where several want a free slot, the last one has it."""
        at, number, rest = self._home(h), np.arange(n, n + len(h), dtype=np.int32), np.arange(len(h))
        while len(rest):
            free = rest[self.numbers[at[rest]] < 0]
            self.numbers[at[free]] = number[free]
            rest = rest[self.numbers[at[rest]] != number[rest]]
            at[rest] = at[rest] + 1 & len(self.keys) - 1
        self.keys[at] = h

    def _add(self, h: np.ndarray) -> None:
        self.own, held = _behind(self.own, self.n, h), self.n
        self.n += len(h)
        if 2 * self.n > len(self.keys):
            self._slots(int(4 * self.n).bit_length())
            h, held = self.own[: self.n], 0
        self._put(h, held)


class Remembered(Numbers):
    """Subword ids of the first FLUSH words that a process cuts, by its own hashes of them, for all its tasks."""

    def __init__(self, vocabulary: str) -> None:
        self.subwords, self.parts = subwords(vocabulary), Parts()
        self.clear()
        self._slots(16)

    def encode(self, words: list[bytes], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As Subwords.encode(), of different words and their hashes."""
        k = self._find(h)
        new, old = np.flatnonzero(k < 0), np.flatnonzero(k >= 0)
        ids, sizes = self.subwords.encode([words[x] for x in new.tolist()])
        flat, size = self.parts.of(k[old])
        at, n = np.concatenate([old, new]), np.concatenate([size, sizes])
        begin, whole = np.empty_like(n), np.empty_like(n)
        begin[at], whole[at] = np.cumsum(n) - n, n
        kept = new[: max(FLUSH - self.n, 0)]
        if len(kept):
            self._add(h[kept])
            self.parts.add(ids[: int(sizes[: len(kept)].sum())], sizes[: len(kept)])
        return np.concatenate([flat, ids])[_runs(begin, whole)], whole


@functools.lru_cache(maxsize=2)
def remembered(path: str) -> Remembered:
    return Remembered(path)


class Lexicon(Numbers):
    """Local numbers of the words of texts, found by this process's own 64-bit hashes, and hashes that are alike everywhere: of their ids (``every``) or of their bytes. Words are known until clear(), which is called where FLUSH of them are held."""

    def __init__(self, vocabulary: str, every: bool = False) -> None:
        self.vocabulary, self.subwords, self.every = vocabulary, subwords(vocabulary), every
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.hash = np.zeros(0, np.uint64)

    def learn(self, n: int, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Take in words not met before, numbered from n on, with their subword ids."""

    def _number(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, new ones where not met before, and where these occur first."""
        x = self._find(h)
        unknown = np.flatnonzero(x < 0)
        if not len(unknown):
            return x, unknown
        fresh, first, which = np.unique(h[unknown], return_index=True, return_inverse=True)
        order = np.argsort(first)  # numbers go by where words first occur, whatever the hashes
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        x[unknown] = self.n + place[which]
        self._add(fresh[order])
        return x, unknown[first[order]]

    def read(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """Local numbers of each text's words, and of all in order."""
        each, new, n = [], [], self.n
        for group in _groups(texts):
            words, ends = [], []
            for text in group:
                words += lower_words(text)
                ends.append(len(words))
            h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
            x, first = self._number(h)
            new += [words[k] for k in first.tolist()]
            each += np.split(x, ends[:-1])
        if new:
            ids, size = remembered(self.vocabulary).encode(new, self.own[n : self.n])
            h = word_keys(ids, size) if self.every else word_hashes(new, len(new))
            self.hash = _behind(self.hash, n, h)
            self.learn(n, h, ids, size)
        return each, np.concatenate(each) if each else np.zeros(0, np.int64)


class _Reader(Lexicon):
    """Words with their subword ids, and how often each is met."""

    def clear(self) -> None:
        super().clear()
        self.parts, self.times = Parts(), np.zeros(0, np.int64)

    def learn(self, n: int, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.add(ids, sizes)
        self.times = _behind(self.times, n, np.zeros(len(hashes), np.int64))

    def asked(self, each: list[np.ndarray], w: np.ndarray) -> list[np.ndarray]:
        """What the network reads of texts, as read() gave them: ids of all words' subwords, or of their first ones."""
        if not self.every:
            return [self.parts.flat[self.parts.begin[x]] for x in each]
        flat, size = self.parts.of(w)
        whole = np.append(0, np.cumsum(size))
        return np.split(flat, whole[np.cumsum([len(x) for x in each])[:-1]]) if each else []

    def look_up(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        """As read(), but what is met doesn't count."""
        return super().read(texts)

    def read(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        each, w = super().read(texts)
        self.times[: self.n] += np.bincount(w, minlength=self.n)
        return each, w

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Kinds, keys and numbers of all that was read since clear()."""
        n = self.n
        if not n:
            return
        times, size, ids = self.times[:n], self.parts.size[:n], self.parts.flat[: self.parts.m]
        yield WORD, self.hash[:n].view(np.int64)[times > 0], times[times > 0]
        for kind, key, k in ((ID, ids, np.repeat(times, size)), (FIRST, ids[self.parts.begin[:n]], times))[: 1 if self.every else 2]:
            total = np.bincount(key, weights=k, minlength=N_IDS).astype(np.int64)
            yield kind, np.flatnonzero(total), total[total > 0]
        if self.every:
            return
        steps, at = np.unique(steps_of(ids, size), return_inverse=True)
        yield STEP, steps, np.bincount(at, weights=np.repeat(times, size)).astype(np.int64)


class Scorer(Lexicon):
    """Scores batches of texts. Words keep what their counts, subwords and spelling give."""

    def __init__(self, model: Model, hashes: np.ndarray, counts: np.ndarray, total: int, vocabulary: str) -> None:
        self.model, self.hashes, self.counts, self.total = model, hashes, counts, max(total, 1)
        super().__init__(vocabulary)

    def clear(self) -> None:
        super().clear()
        self.frequent, self.parts = np.zeros(0, bool), Parts()
        self.log, self.share, self.spelled = (np.zeros(0) for _ in range(3))

    def learn(self, n: int, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
        times = np.where(known, self.counts[at] if len(self.counts) else 0, 0)
        *parts, spelled = self.model.spelled(ids, sizes)
        self.parts.add(*parts)
        for name, x in (("frequent", known), ("log", np.log10(times + 1)), ("share", times / self.total), ("spelled", spelled)):
            setattr(self, name, _behind(getattr(self, name), n, x))

    def outcomes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What attention is asked for of the words that read() gave, and how many each has."""
        return self.parts.of(w)

    def __call__(self, texts: list[bytes]) -> tuple:
        """For each text: words, words that are frequent, their log10 sum, the model's score, as if other words were not met in training, and the network's alone; hashes of the other words, and the log10 probability of each's every occurrence."""
        if self.n > FLUSH:
            self.clear()
        each, w = self.read(texts)
        sizes = np.array([len(x) for x in each])
        text = np.repeat(np.arange(len(texts)), sizes)
        frequent = self.frequent[w]
        known = np.bincount(text, weights=frequent, minlength=len(texts)).astype(np.int64)
        logs = np.bincount(text, weights=self.log[w], minlength=len(texts))
        by_word, end = self.model.scores(*self.outcomes(w), sizes)
        by_word += self.spelled[w]
        attention = end + np.bincount(text, weights=by_word, minlength=len(texts))
        both = np.log(np.exp(by_word * np.log(10)) + self.share[w] + 1e-300) / np.log(10)
        score = end + np.bincount(text, weights=np.maximum(both, by_word) - np.log10(2), minlength=len(texts))
        # the other words, by text and word: lists of hashes, each with the list of its probabilities
        k = np.flatnonzero(~frequent)
        k = k[np.lexsort((w[k], text[k]))]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (w[k[1:]] != w[k[:-1]]) | (text[k[1:]] != text[k[:-1]])
        kinds = k[fresh]
        lists = np.searchsorted(text[kinds], np.arange(len(texts) + 1)).astype(np.int32)
        parts = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(fresh), len(k)).astype(np.int32)), pa.array(by_word[k]))
        return sizes, known, logs, score, attention, pa.ListArray.from_arrays(pa.array(lists), pa.array(self.hash[w[kinds]].view(np.int64))), pa.ListArray.from_arrays(pa.array(lists), parts)


class SubwordScorer(Scorer):
    """As Scorer, of texts that are given as their ids, as _read_rows() gives them: so texts are cut into subwords once, not twice."""

    def read(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
        each, self.held = [], []
        for group in _groups(texts):
            ids = np.frombuffer(b"".join(group), "<u2").astype(np.int64)
            opens = self.subwords.opens[ids]
            starts = np.flatnonzero(opens)
            size = np.diff(np.append(starts, len(ids)))
            self.held.append((self.model.classes.of[ids], size))
            h, n = word_keys(ids, size), self.n
            x, first = self._number(h)
            if len(first):
                self.hash = _behind(self.hash, n, h[first])
                self.learn(n, h[first], ids[_runs(starts[first], size[first])], size[first])
            words = np.append(0, np.cumsum(opens))
            each += np.split(x, words[np.cumsum([len(t) // 2 for t in group])[:-1]])
        return each, np.concatenate(each) if each else np.zeros(0, np.int64)

    def outcomes(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the texts' own ids, as they stand: no look-up by word."""
        return tuple(np.concatenate(x) for x in zip(*self.held)) if self.held else self.parts.of(w)


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, every: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document. every: attention over all subwords."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).withColumn("held_out", held_out())
    training = rows.filter("NOT held_out")
    if every:
        seen = _seen(rows, vocabulary, every)
        model, counts = _learned(seen, vocabulary, every)
        whole = seen.filter(F.col("kind") == WHOLE).select(F.col("key").alias("doc_id"), F.col("whole").alias("text")).withColumn("held_out", held_out())
    else:
        model, counts = fit(training, vocabulary)
        whole = rows.select("doc_id", "text", "held_out")
    totals = counts.agg(F.sum("n").alias("words"), F.count("*").alias("kinds")).first()
    ends = training.count()
    train_tokens, kinds = int(totals["words"] or 0) + ends, totals["kinds"] + (1 if ends else 0)
    floor = np.log10(train_tokens + kinds + 1)
    # the least count that at most FREQUENT words reach
    steps = counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(FREQUENT).collect()
    held, least = 0, 1 << 62
    for r in steps:
        held += r["k"]
        if held > FREQUENT:
            break
        least = r["n"]
    frequent = counts.filter(F.col("n") >= least).toPandas().sort_values("key", kind="stable")
    order = np.argsort(frequent["key"].to_numpy(np.int64).view(np.uint64))
    sent = spark.sparkContext.broadcast((model, frequent["key"].to_numpy(np.int64).view(np.uint64)[order], frequent["n"].to_numpy(np.int64)[order], train_tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        scorer = (SubwordScorer if every else Scorer)(*sent.value, vocabulary)
        for batch in batches:
            sizes, known, logs, score, attention, rare, parts = scorer(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes + 1, pa.int64()), pa.array(known), *(pa.array(x.astype(np.float64)) for x in (logs, score, attention)), rare, parts],
                names=["doc_id", "held_out", "n_tokens", "known", "logs", "score", "attention_score", "rare", "parts"],
            )

    scored = whole.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, logs double, score double, attention_score double, rare array<long>, parts array<array<double>>")
    scored = materialize(scored).withColumn("_row", F.monotonically_increasing_id())
    other = scored.select("_row", F.explode(F.arrays_zip("rare", "parts")).alias("x")).select("_row", F.col("x.rare").alias("key"), F.col("x.parts").alias("parts"))
    times = F.size("parts")
    # what the mixture gives a known word beyond an unknown one, as Scorer reckons it
    half, share = float(np.log10(2)), F.col("n") / F.lit(float(max(train_tokens, 1)))
    gain = F.aggregate("parts", F.lit(0.0), lambda total, x: total + F.greatest(F.log10((F.pow(F.lit(10.0), x) + share) / 2 + F.lit(1e-300)) - x + half, F.lit(0.0)))
    met = other.join(counts.filter(F.col("n") < least), "key").groupBy("_row").agg(F.sum(times).alias("r_known"), F.sum(times * F.log10(F.col("n") + 1)).alias("r_logs"), F.sum(gain).alias("r_gain"))
    out = scored.drop("rare", "parts").join(met, "_row", "left")
    ends_log = float(np.log10(ends + 1))
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    base = F.col("logs") + F.coalesce("r_logs", none) + F.lit(ends_log) - F.col("n_tokens") * F.lit(float(floor))
    known = F.col("known") + F.coalesce("r_known", zero) + F.lit(1 if ends else 0)
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("r_gain", none)).alias("score"), "attention_score")


def op5_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and attention_score of every document. Awkward cases: see the module."""
    return score_documents(read_table(spark, sf_dir, "documents"), every=True)
