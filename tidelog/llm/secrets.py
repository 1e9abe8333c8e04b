"""Secret scans: base patterns and a linear-chain conditional random field."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, table
from .words import U, Words, text_bytes, words

#: (kind, pattern, group whose length counts, least length), in the contract's order.
BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
#: Signs that part tokens, and those of them that settings and code are full of.
SEPARATORS, SIGNS = " \t\n\v\f\r\"'`=:<>(){}[],;|", "=:({[<"
#: Every token of a text, after what parts it from the one before.
TOKEN = re.compile(rf"([{re.escape(SEPARATORS)}]*)([^{re.escape(SEPARATORS)}]+)")
#: Number of each separator's byte, from 1 on; 0 for all others.
PARTS = np.zeros(256, np.int64)
PARTS[list(SEPARATORS.encode())] = np.arange(1, len(SEPARATORS) + 1)
CUE = re.compile(r"(?:\w*[_.-])?(password|passwd|passphrase|pwd|secret|token|api_?key|key|bearer|auth|credentials?)[.?!]?", re.I | re.A)
LONG_HEX = re.compile(r"[0-9a-f]{16}")
OUT, BEGIN, IN = 0, 1, 2
#: Hash buckets of features, and the bound of the training sample: rows drawn by a hash,
#: of these the documents with and without a base span, and the bytes of one.
BUCKETS, SAMPLE_DRAWN, SAMPLE_ROWS, SAMPLE_BYTES = 4096, 8000, 200, 20_000
EPOCHS, RATE, DECAY, MARGIN = 30, 0.5, 1e-3, 8
#: Texts with made-up secrets in their place, at least, as far as ten rounds go.
ROUNDS = 150
#: Tokens of a stretch, tokens a worker keeps, characters decoded at once and those
#: that such pieces of a longer text share on either side; tokens learnt together.
STRETCH, CACHE, CHARS, SHARED, LESSON = 128, 1 << 18, 1 << 21, 1 << 12, 24
LOW = -1e9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, group, least in BASE:
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text or kind == "hex" and not LONG_HEX.search(text):
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    rank = {k: i for i, (k, *_) in enumerate(BASE)}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


def tokens(text: str) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Separators before, tokens, and their starts and ends."""
    found = TOKEN.findall(text)
    seps, toks = [x for x, _ in found], [x for _, x in found]
    size = np.fromiter(map(len, toks), np.int64, len(toks))
    ends = np.cumsum(size + np.fromiter(map(len, seps), np.int64, len(toks)))
    return seps, toks, ends - size, ends


def bucket(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


SHAPE = str.maketrans("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "a" * 26 + "A" * 26 + "9" * 10)
RUNS = re.compile(r"(.)\1+", re.S)
VOWELS = re.compile("[aeiouyAEIOUY]")


@functools.lru_cache(1 << 16)
def common(kind: str, size: int, digits: int, shape: str, turns: int, vowels: int) -> tuple[list[int], list[int]]:
    """Features of all tokens of one shape, without and with a cue before them."""
    own = [f"k{kind}", f"k{kind}{size}", f"d{digits}", f"s{size}", f"p{shape}", f"t{turns}{size}", f"v{vowels}{size}"]
    plain, near = ([bucket(x) for x in [*own, f"w{n}{kind}", f"w{n}s{size}", f"w{n}t{turns}", f"w{n}"]] for n in (False, True))
    return plain, near


@functools.lru_cache(1 << 17)
def shape_of(t: str) -> tuple[list[int], list[int], int, bool]:
    """Features of a token without and with a cue before it, the one it is for the
    token after it, and whether it is a cue."""
    shape = t[:64].translate(SHAPE)
    runs = RUNS.sub(r"\1", shape)
    kind = "hex" if not t.strip("0123456789abcdef") else "up" if t.isupper() and t.isalnum() else "num" if not t.strip("0123456789.-") else "low" if t.isalpha() and t.islower() else "mix" if t.isalnum() else "sym"
    # How often the class of the characters changes, and vowels among the letters.
    letters = shape.count("a") + shape.count("A")
    vowels = len(VOWELS.findall(t[:64])) * 4 // letters if letters else 9
    plain, near = common(kind, min(len(t) // 4, 12), shape.count("9") * 4 // len(shape), runs[:6], min(len(runs) * 4 // len(shape), 4), vowels)
    own = bucket(f"x{t[:4]}")
    return [*plain, own], [*near, own], bucket(f"l{t[-8:].lower()}"), CUE.fullmatch(t) is not None


def file_of(signs: int, size: int) -> int:
    """The feature that a text gives all its tokens: how many of them come after a sign
    of settings or code, and its size."""
    return bucket(f"f{min(signs * 8 // max(size, 1), 4)}{min(size.bit_length() // 3, 4)}")


def features(text: str) -> np.ndarray:
    """Feature buckets of each token: shape, cues among the two tokens before it,
    the token before it, the separators around it, and the file's."""
    seps, toks, _, _ = tokens(text)
    got, rows, whole = [shape_of(t) for t in toks], [], file_of(sum(any(x in SIGNS for x in y) for y in seps), len(toks))
    for i, g in enumerate(got):
        near = any(x[3] for x in got[max(0, i - 2) : i])
        after = seps[i + 1][:1] if i + 1 < len(got) else ""
        rows.append([*g[near], got[i - 1][2] if i else bucket("l"), bucket(f"b{seps[i][-2:]}"), bucket(f"a{after}"), whole])
    return np.array(rows, np.int64) if rows else np.zeros((0, 1), np.int64)


class Emission:
    """Scores of tokens from rows that are made when a token is first met; the tokens,
    by 64-bit hash, of all texts at once."""

    def __init__(self, state: np.ndarray):
        self.state = state
        self.first = state[bucket("l")]
        names = ["", *SEPARATORS]
        self.after = np.array([state[bucket(f"a{x}")] for x in names])
        self.before = np.array([[state[bucket(f"b{x}{y}")] for y in names] for x in names])
        self.forget()

    def forget(self) -> None:
        self.known, self.rows = np.zeros(0, U), np.zeros((0, 10))

    def meet(self, keys: np.ndarray, new: list[str]) -> None:
        got = [shape_of(t) for t in new]
        plain, near, after = (self.state[np.array([g[i] for g in got])] for i in range(3))
        rows = np.concatenate([plain.sum(1), near.sum(1), after, np.array([[g[3]] for g in got])], 1)
        order = np.argsort(keys)
        place = np.searchsorted(self.known, keys[order])
        self.known, self.rows = np.insert(self.known, place, keys[order]), np.insert(self.rows, place, rows[order], axis=0)

    def scores(self, w: Words, off: np.ndarray) -> np.ndarray:
        """What Chain.scores() gives for features(), of the tokens of texts that lie at
        off in the data."""
        which, keys = pd.factorize(w.hash)
        if len(self.known) > CACHE:
            self.forget()
        place = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        old = np.flatnonzero(place < len(self.known))
        new[old] = self.known[place[old]] != keys[old]
        if new.any():
            at = np.zeros(len(keys), np.int64)
            at[which] = np.arange(len(which))
            texts = [w.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist())]
            self.meet(keys[new], texts)
            place = np.searchsorted(self.known, keys)
        r = self.rows[place][which]
        one, two = (np.concatenate([np.zeros(k, bool), w.doc[k:] == w.doc[:-k]]) for k in (1, 2))
        cue = r[:, 9] > 0
        near = one & np.append(False, cue[:-1]) | two & np.concatenate([[False] * 2, cue[:-2]])[: len(cue)]
        out = np.where(near[:, None], r[:, 3:6], r[:, :3])
        out += np.where(one[:, None], np.concatenate([np.zeros((1, 3)), r[:-1, 6:9]]), self.first)
        # Separators: up to two before a token, in its text, and the one after it.
        code = np.concatenate([[0, 0], PARTS[w.data], [0]])
        begin = off[w.doc]
        last = np.where(w.start - 1 >= begin, code[w.start + 1], 0)
        out += self.before[np.where((w.start - 2 >= begin) & (last > 0), code[w.start], 0), last]
        inner = np.append(one[1:], False)
        out += self.after[np.where(inner, code[w.end + 2], 0)]
        sign = np.cumsum(np.append(0, SIGN[w.data]))
        since = np.where(one, np.append(0, w.end[:-1]), begin)
        signs = np.bincount(w.doc, sign[w.start] > sign[since], len(off)).astype(int)
        size = np.diff(w.first)
        return out + np.array([self.state[file_of(x, y)] for x, y in zip(signs.tolist(), size.tolist())])[w.doc]


SIGN = np.zeros(256, np.int64)
SIGN[list(SIGNS.encode())] = 1


class Chain:
    """A linear-chain CRF over OUT, BEGIN and IN; IN can't follow OUT or come first."""

    def __init__(self):
        self.state, self.move = np.zeros((BUCKETS, 3)), np.zeros((3, 3))

    def scores(self, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        s = np.array([self.state[r].sum(0) for r in rows]).reshape(-1, 3)
        s[0, IN] = -1e9
        move = self.move.copy()
        move[OUT, IN] = -1e9
        return s, move

    def viterbi(self, rows: list[list[int]]) -> list[int]:
        s, move = self.scores(rows)
        best, back = s[0], []
        for x in s[1:]:
            way = best[:, None] + move
            back.append(way.argmax(0))
            best = way.max(0) + x
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def best(self, s: np.ndarray, new: np.ndarray) -> np.ndarray:
        """The best tags of chains in a row by their scores and a flag at the first token
        of each: the same as decode(), which runs only where a span can pay at all.

        A token can be tagged only if some stretch that holds it gains more, with every
        token's best tag and the best moves, than being outside costs.
        """
        out = np.zeros(len(s), np.int8)
        if not len(s):
            return out
        stay = self.move[OUT, OUT]
        come = max(0.0, self.move[OUT, BEGIN] - stay, (self.move[1:, 1:] - stay).max())
        leave = max(0.0, (self.move[1:, OUT] - stay).max())
        total = np.cumsum(s[:, 1:].max(1) - s[:, OUT] + come)
        low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        high = np.maximum.accumulate(total[::-1])[::-1]
        may = high - low + leave > -1e-6
        # A neighbour on either side, of the same text, is outside and bounds the stretch.
        end = np.append(new[1:], True)
        near = may | np.append(may[1:], False) & ~end | np.concatenate([[False], may[:-1]]) & ~new
        at = np.flatnonzero(near)
        part = s[at]
        part[~may[at], 1:] = LOW
        first = new[at]
        first[1:] |= np.diff(at) > 1
        first[:1] = True
        out[at] = self.decode(part, first)
        return out

    def decode(self, s: np.ndarray, new: np.ndarray) -> np.ndarray:
        """viterbi() of chains in a row by their scores and a flag at the first token of
        each. Stretches are solved side by side for every state before them, then
        joined, so the tags are the best of the whole chains."""
        n = len(s)
        k = -(-n // STRETCH)
        s = np.concatenate([s, np.zeros((k * STRETCH - n, 3))]).reshape(k, STRETCH, 3)
        new = np.concatenate([new, np.ones(k * STRETCH - n, bool)]).reshape(k, STRETCH)
        move = self.move.copy()
        move[OUT, IN] = LOW
        reset = np.array([[0, 0, LOW]] * 3)
        best = np.broadcast_to(np.where(np.eye(3, dtype=bool), 0, 2 * LOW), (k, 3, 3))
        back = np.zeros((STRETCH, k, 3, 3), np.int8)
        for t in range(STRETCH):
            way = best[:, :, :, None] + np.where(new[:, t, None, None], reset, move)[:, None]
            back[t] = way.argmax(2)
            best = way.max(2) + s[:, t, None, :]
        value, came = np.zeros(3), []
        for b in best:
            way = value[:, None] + b
            came.append(way.argmax(0))
            value = way.max(0)
            value = value - value.max()
        last, first, state = np.zeros(k, np.int64), np.zeros(k, np.int64), int(value.argmax()) if k else 0
        for i in range(k - 1, -1, -1):
            last[i], first[i] = state, came[i][state]
            state = int(first[i])
        out, row = np.zeros((STRETCH, k), np.int8), np.arange(k)
        for t in range(STRETCH - 1, -1, -1):
            out[t] = last
            last = back[t][row, first, last]
        return out.T.reshape(-1)[:n]

    def learn(self, data: list[tuple[np.ndarray, list[int]]]) -> None:
        """Maximum likelihood with weight decay: AdaGrad on forward-backward marginals,
        of stretches side by side."""
        data = [(r[a : a + LESSON], g[a : a + LESSON]) for r, g in data for a in range(0, len(r), LESSON)]
        if not data:
            return
        size = np.array([len(r) for r, _ in data])
        k, top = len(data), lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        on = np.arange(size.max())[None] < size[:, None]
        rows = np.concatenate([r for r, _ in data])
        gold = np.zeros(on.shape, np.int64)
        gold[on] = np.concatenate([g for _, g in data])
        hot, both = np.eye(3)[gold] * on[:, :, None], on[:, 1:]
        pairs = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in range(3)] for a in range(3)])
        gs, gm = np.full_like(self.state, 1e-6), np.full_like(self.move, 1e-6)
        for _ in range(EPOCHS):
            s = np.zeros((*on.shape, 3))
            s[on] = sum(self.state[c] for c in rows.T)
            s[:, 0, IN] = LOW
            move = self.move.copy()
            move[OUT, IN] = LOW
            f, b = np.zeros_like(s), np.zeros_like(s)
            f[:, 0] = s[:, 0]
            for t in range(1, s.shape[1]):
                f[:, t] = np.where(on[:, t, None], top(f[:, t - 1, :, None] + move, 1) + s[:, t], f[:, t - 1])
            for t in range(s.shape[1] - 2, -1, -1):
                b[:, t] = np.where(on[:, t + 1, None], top(move + (s[:, t + 1] + b[:, t + 1])[:, None], 2), 0)
            z = top(f[:, -1], 1)[:, None, None]
            d = ((hot - np.exp(np.minimum(f + b - z, 0)))[on]) / k
            ds = np.stack([sum(np.bincount(c, d[:, x], BUCKETS) for c in rows.T) for x in range(3)], 1) - DECAY * self.state / k
            p = np.zeros((3, 3))
            for t in range(1, s.shape[1]):
                x = f[:, t - 1, :, None] + move + (s[:, t] + b[:, t])[:, None] - z
                p += (np.exp(np.minimum(x, 0)) * on[:, t, None, None]).sum(0)
            dm = (pairs - p) / k - DECAY * self.move / k
            gs += ds**2
            gm += dm**2
            self.state += RATE * ds / np.sqrt(gs)
            self.move += RATE * dm / np.sqrt(gm)


def values(r: random.Random) -> list[str]:
    """Made-up secrets of kinds the base patterns don't have."""
    pick = lambda n, a: "".join(r.choice(a) for _ in range(n))
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = low + up + digits
    part = lambda: pick(r.randint(12, 40), word + "-_")
    signs = pick(r.randint(3, 6), word) + r.choice("@$!#%") + pick(r.randint(4, 8), word) + r.choice("!?*&^") + pick(r.randint(1, 4), digits)
    return [
        pick(r.randint(14, 40), word), f"{pick(r.randint(2, 4), low)}_{pick(r.randint(20, 40), word)}", f"ey{part()}.{part()}.{part()}",
        pick(r.randint(20, 44), word + "+/") + "==", pick(r.randint(16, 32), up + digits), f"{pick(2, low)}-{pick(r.randint(16, 40), word)}", signs,
    ]


def harmless(r: random.Random, words: list[str]) -> list[str]:
    """Made-up tokens that look odd and are no secrets, some of words of the text."""
    n, word = lambda a, b: str(r.randint(a, b)), lambda: r.choice(words or ["text"])
    return [
        f"{word()}.{n(1, 99)}@mail{n(1, 9)}.example.com", f"https://www.{word()}{n(1, 99)}.example.org/{word()}/{n(1, 9999)}", f"{n(1990, 2030)}-0{n(1, 9)}-{n(10, 28)}", f"{n(1, 255)}.{n(0, 255)}.{n(0, 255)}.{n(1, 255)}",
        f"+{n(1, 99)}-{n(100, 999)}-{n(1000, 9999)}", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 20)}", f"{word()}_{word()}_{n(1, 99)}", f"{word()}{word().title()}{word().title()}", f"{word()}{n(1, 99)}.html", f"{word()}{word()}".upper() + r.choice(["", "!!", "."]), f"{word()}{word()}" + r.choice(["###", "&&&", ","]), word(), word() + word() + word(),
    ]


def views(text: str, spans: list[tuple[str, int, int]], rounds: int = 1) -> list[tuple[str, list[tuple[int, int]]]]:
    """The text with its gold spans, and for its first assignment short texts no base
    pattern fits: other secrets, and harmless tokens, after a cue and a link or, the
    context masked, among words of the text alone. Only what a reader would know by
    its own look, or by the cue, is gold."""
    out = [(text, [(a, b) for _, a, b in spans])]
    r = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    for kind, a, b in spans:
        if kind != "assign":
            continue
        m = BASE[0][1].match(text, a)
        near, after = " ".join(text[max(0, a - 30) : a].split()), " ".join(text[b : b + 30].strip("\"'").split())
        words = [w for w in after.split() + near.split() if w.isalpha()]
        for link in (" ", " is ", " = ", None) * rounds:
            head = f"{near} " if link is None else f"{near} {r.choice([m[1], 'passcode', 'bearer', 'key', 'auth'])}{link}"
            secret, odd = r.sample(values(r), 3), r.sample(harmless(r, words), 3)
            if link is not None:
                secret.append("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(12, 24))))
            out += [(f"{head}{v} {after}", [(len(head), len(head) + len(v))]) for v in secret]
            out += [(f"{head}{v} {after}", []) for v in odd]
        break
    return out


def train(texts: list[str]) -> Chain:
    """Fit to the base spans of a sample, and to views() of them: a token is inside
    a span or outside. Without any base span there is nothing to learn and nothing is
    ever tagged."""
    if not any(map(base_spans, texts)):
        return Chain()
    data = []
    # A sample with few secrets shows each more often.
    rounds = -(-ROUNDS // sum(any(k == "assign" for k, *_ in base_spans(t)) for t in texts)) if any(k == "assign" for t in texts for k, *_ in base_spans(t)) else 1
    for text in texts:
        for view, spans in views(text, base_spans(text), min(rounds, 10)):
            _, toks, start, end = tokens(view)
            gold, before = [], None
            for a, b, t in zip(start.tolist(), end.tolist(), toks):
                hit = next((s for s in spans if s[0] < b and a < s[1]), None)
                if hit and CUE.fullmatch(t):
                    hit = None  # the name of an assignment is no secret
                gold.append(OUT if hit is None else IN if hit is before else BEGIN)
                before = hit
            data.append((features(view), gold))
    model = Chain()
    model.learn(data)
    # Opening a span costs more until the field tags nothing in the sample's own texts
    # that no base span explains, so what it adds elsewhere stands out.
    whole = [(t, base_spans(t)) for t in texts]
    for _ in range(MARGIN):
        found = tagged([t for t, _ in whole], model, Emission(model.state))
        if all(any(a < s[2] and s[1] < b for s in spans) for (_, spans), tags in zip(whole, found) for a, b in tags):
            break
        model.move[OUT, BEGIN] -= 1
    return model


def tagged(texts: list[str], model: Chain, emission: Emission) -> list[list[tuple[int, int]]]:
    """Spans that the field tags in each text, in code points."""
    col = pa.array(texts, pa.large_string())
    w = words(col, separator=PARTS > 0)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(w.hash):
        return out
    off = text_bytes(col)[1]
    tag = model.best(emission.scores(w, off[:-1]), np.append(True, w.doc[1:] != w.doc[:-1]))
    for i in np.flatnonzero(tag != OUT).tolist():
        doc = int(w.doc[i])
        a, b = int(w.start[i] - off[doc]), int(w.end[i] - off[doc])
        if tag[i] == BEGIN:
            out[doc].append((a, b))
        else:
            out[doc][-1] = (out[doc][-1][0], b)
    for doc, spans in enumerate(out):
        if spans and off[doc + 1] - off[doc] > len(texts[doc]):
            raw = texts[doc].encode()
            out[doc] = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in spans]
    return out


def all_of(texts: list[str], model: Chain, emission: Emission) -> list[tuple[list, list]]:
    """all_spans() of each text. A text of more than CHARS characters is decoded in
    overlapping pieces, each of which gives the spans that start in its own part."""
    short = [t if len(t) <= CHARS else "" for t in texts]
    out, rank = [], {k: i for i, (k, *_) in enumerate(BASE)} | {"crf": len(BASE)}
    for text, spans in zip(texts, tagged(short, model, emission)):
        for a in range(0, len(text) if len(text) > CHARS else 0, CHARS):
            low = max(0, a - SHARED)
            [part] = tagged([text[low : a + CHARS + SHARED]], model, emission)
            spans += [(x + low, y + low) for x, y in part if a <= x + low < a + CHARS]
        base = base_spans(text)
        added = [("crf", x, y) for x, y in spans if all(y <= s[1] or s[2] <= x for s in base)]
        out.append((base, sorted(base + added, key=lambda s: (s[1], rank[s[0]], s[2]))))
    return out


def all_spans(text: str, model: Chain) -> tuple[list, list]:
    """(base spans, base and added spans by start): the method adds what it tags
    outside the base spans."""
    return all_of([text], model, Emission(model.state))[0]


def fit(docs: DataFrame) -> Chain:
    """Train on a bounded sample, in one task: of SAMPLE_DRAWN rows in expectation, drawn
    by a hash and of at most SAMPLE_BYTES each, the first SAMPLE_ROWS with a base span
    and as many without. The driver gets the weights."""
    n = docs.count()
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40))
    d = docs.where(F.octet_length("text") <= SAMPLE_BYTES).select(place.alias("place"), "text")
    d = d.where(F.col("place") < int(min(1.0, SAMPLE_DRAWN / max(n, 1)) * (1 << 40)))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bool, list[str]] = {False: [], True: []}
        for text in (t.as_py() for b in batches for t in b.column("text")):
            held = kept[bool(base_spans(text))]
            if len(held) < SAMPLE_ROWS:
                held.append(text)
        model = train(kept[True] + kept[False])
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()], pa.binary()) for x in (model.state, model.move)], ["state", "move"])

    got = d.repartition(1).sortWithinPartitions("place", "text").mapInArrow(learn, "state binary, move binary").collect()
    model = Chain()
    if got:
        model.state, model.move = np.frombuffer(got[0][0]).reshape(BUCKETS, 3).copy(), np.frombuffer(got[0][1]).reshape(3, 3).copy()
    return model


def scan_secrets(docs: DataFrame, model: Chain | None = None) -> DataFrame:
    """Every row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null text counts as empty: no spans, the hash of ''. Spans are in code points,
    end exclusive. The CRF is fitted to the table's own base spans unless given; a
    table without any adds none. Repeated rows are each judged; other columns are
    ignored.
    """
    model = model or fit(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        join = lambda s: ",".join(f"{k}:{a}:{b}" for k, a, b in s)
        emission = Emission(held.value.state)
        for b in rows_of(batches, "text", CHARS):
            out = []
            for base, every in all_of([t.as_py() or "" for t in b.column("text")], held.value, emission):
                count = [sum(s[0] == k for s in base) for k, *_ in BASE]
                out.append((*count, hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
            cols = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
