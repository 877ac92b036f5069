"""Personal data: rules for e-mail, ip, card and phone, and a character-level BiLSTM with CRF.

The rules give the base spans. The tagger adds spans that the rules miss, such as a phone number
without its country or a written-out address sign: it is a bidirectional LSTM over character
classes with CRF transitions, trained in numpy from labelled spans (the base spans of a bounded
sample of pieces of texts, and written variants of such data, and numbers that only look like it, put
into contexts of that sample). A
text is tagged in overlapping windows around the characters and words that any personal data has;
where windows overlap their emissions are averaged, and one Viterbi path is found through each whole
stretch. The path is settled as soon as all tags' best paths agree, so a stretch of any length needs
the memory of a chunk. A tagged span is added if it has its kind's digits or signs and doesn't touch
another span.

Defined results: a null text is empty and has no spans; repeated rows and rows without id stay; an
empty table gives none; further columns, whatever their names, stay (redact) or don't matter.
Without any span in the sample the tagger learns from the written variants alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.llm.common import id_and_text, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: The tagger is fitted on a bounded sample: about SAMPLE documents are looked at for labelled spans,
#: whole, and of the PIECE characters long pieces of their stretches WINDOWS are learned from, at most.
SAMPLE = 20_000
WINDOWS = 3_000
PIECE = 512
#: Share of the windows put together for learning that hold a number which is no personal data.
OTHERS = 0.4
#: Shares of the kinds among the variants; phones have the most forms.
SHARES = (0.35, 0.03, 0.12, 0.5)
#: Characters of a stretch that are tagged at a time, and rows whose texts a task holds.
CHUNK = 1 << 13
TOGETHER = 512
WIDTH = 64
STEP = 32
HIDDEN = 16
EPOCHS = 8
BATCH = 64
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: What personal data has: a digit, an address sign, or one written out in brackets or before a written-out dot.
_TRIGGER = re.compile(r"[0-9@]|[\[({<] ?[aA][tT] ?[\])}>]|(?<=[A-Za-z0-9]) [aA][tT] (?=[A-Za-z0-9-]+ [dD][oO][tT] )")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from their @: the run of local characters before it starts the match."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[Span]:
    """The rules' spans by start, then kind; code points, end exclusive."""
    out: list[Span] = []
    if not text:
        return out
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            d = digits_of(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


# --- the tagger

_SIGNS = "@.-+()[] _%:/,\n'\"#*|=<>!?;$&"
#: A digit's class is the length of its run of digits, up to LONGEST; other characters' classes follow.
LONGEST = 13
CLASSES = LONGEST + len(_SIGNS) + 5
TAGS = 1 + 2 * len(KINDS)  # 0: none; 1 + 2k: first character of kind k; 2 + 2k: further ones


def _classes() -> np.ndarray:
    table = np.full(128, CLASSES - 2, np.int64)
    for a, b, k in (("0", "9", 0), ("a", "z", LONGEST), ("A", "Z", LONGEST + 1)):
        table[ord(a) : ord(b) + 1] = k
    table[[ord(c) for c in "at"]] = LONGEST + 2  # the letters of a written-out address sign
    for k, c in enumerate(_SIGNS):
        table[ord(c)] = LONGEST + 3 + k
    return table


_TABLE = _classes()


def encoded(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _TABLE[np.minimum(points, 127)], CLASSES - 1)
    digit = codes == 0
    turns = np.flatnonzero(np.diff(digit, prepend=False, append=False))
    runs = turns[1::2] - turns[::2]
    codes[digit] = np.repeat(np.minimum(runs, LONGEST) - 1, runs)
    return codes


def stretches(text: str) -> list[tuple[int, int]]:
    """Unions of the parts within half a window of a trigger, with the whole run of an address's characters
    before one that is no digit; other parts can hold no span."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - STEP), min(len(text), m.end() + STEP)
        if not text[m.start()].isdigit():
            at, least = a, out[-1][1] if out else 0
            while at > least and text[at] in _LOCAL and text[at - 1] in _LOCAL:
                at -= 1
            a = at
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


@dataclass
class Tagger:
    """p: of each direction x (by class), h and b of the four gates; o and c of the emissions; t of the transitions."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Tagger:
        rng, p = np.random.default_rng(seed), {}
        for d in "fb":
            p[f"x{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * HIDDEN))
            p[f"h{d}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"b{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])
        p["o"], p["c"], p["t"] = rng.normal(0, 0.2, (2 * HIDDEN, TAGS)), np.zeros(TAGS), rng.normal(0, 0.05, (TAGS, TAGS))
        return cls(p)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> list[tuple]:
        """One direction over x (rows, steps); by step, in the order walked: step and what backward needs."""
        n, steps = x.shape
        h, c, out, given = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN)), [], self.p[f"x{d}"][x] + self.p[f"b{d}"]
        for s in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = given[:, s] + h @ self.p[f"h{d}"]
            i, f, o = np.split(sigmoid(z[:, : 3 * HIDDEN]), 3, axis=1)
            g = np.tanh(z[:, 3 * HIDDEN :])
            m = mask[:, s : s + 1]
            c2 = (f * c + i * g) * m
            tc = np.tanh(c2)
            h2 = o * tc * m
            out.append((s, h, c, i, f, o, g, tc, h2, m))
            h, c = h2, c2
        return out

    def emissions(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        both = {d: self._run(x, mask, d) for d in "fb"}
        hidden = np.zeros((*x.shape, 2 * HIDDEN))
        for k, d in enumerate("fb"):
            for step in both[d]:
                hidden[:, step[0], k * HIDDEN : (k + 1) * HIDDEN] = step[8]
        return hidden @ self.p["o"] + self.p["c"], both | {"hidden": hidden}

    def loss_gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tag paths y, and its gradient."""
        e, kept = self.emissions(x, mask)
        n, steps, t = *x.shape, self.p["t"]
        # Forward and backward over probabilities, scaled to one at each step.
        top, moves = e.max(axis=2, keepdims=True), np.exp(t)
        w, alpha, beta, z = np.exp(e - top), np.zeros((n, steps, TAGS)), np.ones((n, steps, TAGS)), np.ones((n, steps, 1))
        for s in range(steps):
            v = w[:, s] if s == 0 else (alpha[:, s - 1] @ moves) * w[:, s]
            live = mask[:, s : s + 1] > 0
            z[:, s] = np.where(live, v.sum(axis=1, keepdims=True), 1)
            alpha[:, s] = np.where(live, v / z[:, s], alpha[:, s - 1])
        for s in range(steps - 2, -1, -1):
            back = (w[:, s + 1] * beta[:, s + 1] / z[:, s + 1]) @ moves.T
            beta[:, s] = np.where(mask[:, s + 1 : s + 2] > 0, back, 1)
        total = ((np.log(z) + top)[:, :, 0] * mask).sum(axis=1)
        de = alpha * beta * mask[:, :, None]
        after = (mask[:, :, None] * w * beta / z)[:, 1:].reshape(-1, TAGS)
        dt = moves * (alpha[:, :-1].reshape(-1, TAGS).T @ after)
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -mask[:, 1:])
        rows = np.arange(n)[:, None]
        gold = (e[rows, np.arange(steps), y] * mask).sum(axis=1) + (t[y[:, :-1], y[:, 1:]] * mask[:, 1:]).sum(axis=1)
        de[rows, np.arange(steps), y] -= mask
        de, dt = de / n, dt / n
        hidden = kept["hidden"]
        grad = {"t": dt, "o": np.einsum("nsh,nst->ht", hidden, de), "c": de.sum(axis=(0, 1))}
        dhidden = de @ self.p["o"].T
        for k, d in enumerate("fb"):
            dzs, before = np.zeros((steps, n, 4 * HIDDEN)), np.zeros((steps, n, HIDDEN))
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            for s, h, c, i, f, o, g, tc, _, m in reversed(kept[d]):
                dh = (dh + dhidden[:, s, k * HIDDEN : (k + 1) * HIDDEN]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
                dzs[s], before[s] = dz, h
                dh, dc = dz @ self.p[f"h{d}"].T, dc * f
            flat = dzs.reshape(-1, 4 * HIDDEN)
            grad |= {f"x{d}": np.eye(CLASSES)[x.T.ravel()].T @ flat, f"h{d}": before.reshape(-1, HIDDEN).T @ flat, f"b{d}": flat.sum(axis=0)}
        return float((total - gold).mean()), grad

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        path = Path(self.p["t"])
        return np.concatenate([path.add(e), path.end()])

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        """Tags of each stretch of text: windows side by side, averaged where they overlap, one path each."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        paths = [Path(self.p["t"]) for _ in texts]
        codes = [encoded(t) for t in texts]
        # Chunks of all stretches side by side; of a longer one the next chunk follows on the last window.
        over = [np.zeros((0, TAGS)) for _ in texts]
        live, low = [k for k, t in enumerate(texts) if t], 0
        while live:
            places = [(k, a) for k in live for a in range(low, min(low + CHUNK, max(low + 1, len(texts[k]) - WIDTH + STEP)), STEP)]
            sums = {k: np.zeros((min(CHUNK + STEP, len(texts[k]) - low), TAGS)) for k in live}
            counts = {k: np.zeros(len(sums[k])) for k in live}
            for k in live:
                if low and len(over[k]):
                    sums[k][: len(over[k])] += over[k]
                    counts[k][: len(over[k])] += 1
            for j in range(0, len(places), 256):
                part = places[j : j + 256]
                x, mask = np.zeros((len(part), WIDTH), np.int64), np.zeros((len(part), WIDTH))
                for r, (i, a) in enumerate(part):
                    w = codes[i][a : a + WIDTH]
                    x[r, : len(w)], mask[r, : len(w)] = w, 1
                e, _ = self.emissions(x, mask)
                for r, (i, a) in enumerate(part):
                    m = len(codes[i][a : a + WIDTH])
                    sums[i][a - low : a - low + m] += e[r, :m]
                    counts[i][a - low : a - low + m] += 1
            after = []
            for k in live:
                more = len(texts[k]) - WIDTH + STEP > low + CHUNK  # windows begin beyond this chunk
                n = CHUNK if more else len(sums[k])
                out[k].append(paths[k].add(sums[k][:n] / counts[k][:n, None]))
                if more:
                    over[k] = sums[k][n:]
                    after.append(k)
            live, low = after, low + CHUNK
        return [np.concatenate([*parts, path.end()]) if parts else np.empty(0, np.int64) for parts, path in zip(out, paths)]


class Path:
    """The best path through emissions that come in pieces; tags are given out once all best paths agree on them."""

    def __init__(self, moves: np.ndarray) -> None:
        self.moves, self.best, self.back = moves, None, []

    def add(self, e: np.ndarray) -> np.ndarray:
        """Goes on through e; the tags that are settled by it."""
        for row in e:
            if self.best is None:
                self.best = row
                continue
            moved = self.best[:, None] + self.moves
            self.back.append(moved.argmax(axis=0).astype(np.int8))
            self.best = moved.max(axis=0) + row
        if len(self.back) < CHUNK:
            return np.empty(0, np.int64)
        states, trail = np.arange(TAGS), []
        for row in reversed(self.back):
            states = row[states]
            trail.append(states)
        same = next((k for k, s in enumerate(trail) if (s == s[0]).all()), None)
        if same is None:
            return np.empty(0, np.int64)
        done = np.array([s[0] for s in trail[same:]][::-1], np.int64)
        self.back = self.back[len(done) :]
        return done

    def end(self) -> np.ndarray:
        if self.best is None:
            return np.empty(0, np.int64)
        tags = [int(self.best.argmax())]
        for row in reversed(self.back):
            tags.append(int(row[tags[-1]]))
        return np.array(tags[::-1], np.int64)


def _holds(text: str, kind: int) -> bool:
    """The signs and digits that a tagged span must have."""
    d = len(digits_of(text))
    if kind == 0:
        signed = "." in text and re.search(r"[^\s@]@[^\s@]|[\[({<] ?[aA][tT] ?[\])}>]", text)
        return len(text) >= 6 and bool(signed or re.fullmatch(r"[A-Za-z0-9._%+-]+ [aA][tT] [A-Za-z0-9-]+(?: [dD][oO][tT] [A-Za-z0-9-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}(?:[.:]| \. )[0-9]{1,3}(?:[.:]| \. )[0-9]{1,3}(?:[.:]| \. )[0-9]{1,3}", text)) and all(int(x) <= 255 for x in _NUMBER.findall(text))
    if kind == 2:
        return 12 <= d <= 19 and d >= len(text) - 7 and luhn(digits_of(text))
    return 9 <= d <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().+/-]*[0-9]", text))


_NUMBER = re.compile("[0-9]+")


def added_spans(text: str, tags: np.ndarray, at: int, base: list[Span]) -> list[Span]:
    """Spans of the tags of text[at:...] that hold and touch no base span."""
    out, s = [], 0
    while s < len(tags):
        if tags[s] == 0:
            s += 1
            continue
        kind, e = (tags[s] - 1) // 2, s + 1
        while e < len(tags) and tags[e] == 2 + 2 * kind:
            e += 1
        a, b = at + s, at + e
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1] in " \n\t.,;:":
            b -= 1
        if b > a and _holds(text[a:b], kind) and not any(a < y and x < b for x, _, y in base):
            out.append((a, int(kind), b))
        s = e
    return out


def all_spans(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """The base spans and the added spans of each text."""
    bases = [base_spans(t) for t in texts]
    out: list[tuple[list[Span], list[Span]]] = [(b, []) for b in bases]
    if model is None:
        return out
    parts = [(k, a, b) for k, t in enumerate(texts) if t for a, b in stretches(t)]
    for k in range(0, len(parts), 512):
        some = parts[k : k + 512]
        for (i, a, b), tags in zip(some, model.tag([texts[i][a:b] for i, a, b in some])):
            out[i][1].extend(added_spans(texts[i], tags, a, bases[i]))
    return out


#: Phones as people also write them, and numbers that are none: # is a digit.
PHONES = ("(###) ###-####", "###-###-####", "+1 (###) ###-####", "###.###.####", "+## ### ### ####", "0### ### ####", "##########")
#: Shares of the forms in what is learned from: those that are hard to tell from others come more often.
PHONE_SHARES = (0.12, 0.15, 0.12, 0.15, 0.12, 0.17, 0.17)
SIGN_SHARES = (0.08, 0.08, 0.08, 0.08, 0.08, 0.08, 0.08, 0.44)
LOOKALIKES = {
    "isbn": ("978-#-####-####-#", "978-#-##-######-#", "979-##-###-####-#", "#-##-######-#", "978##########"),
    "order": ("###-###-###-###", "####-####-####", "##-#####-#####", "###-#######-#######", "#########", "############", "##############"),
    "amount": ("###.###.###", "#.###.###.###", "##.###.###,##", "###,###,###", "### ### ###", "# ### ### ###", "########.##"),
    "version": ("#.##.#", "##.#.####", "#.#.#.######", "####.##.##.#"),
    "date": ("20##-##-##", "##/##/20##", "##.##.19##", "20##-##-## ##:##:##", "20##-##-##/20##-##-##", "##:##:##"),
    "years": ("19##-20##", "19## 20## 20##", "19##-19##-20##", "19##/20##/20##", "19##.20##.20##"),
}
ADDRESS_SIGNS = ("@", "(at)", " (at) ", "[at]", " [at] ", "( at )", " (AT) ", " at ")


def filled(shape: str, rng: np.random.Generator) -> str:
    return "".join(str(rng.integers(0, 10)) if c == "#" else c for c in shape)


def address(sign: str, rng: np.random.Generator) -> str:
    w = lambda k: "".join(chr(97 + x) for x in rng.integers(0, 26, k))
    who, host = w(rng.integers(3, 8)) + filled("#" * int(rng.integers(0, 3)), rng), w(rng.integers(3, 8))
    return who + sign + host + (" dot " if sign == " at " else ".") + ("com", "org", "net")[rng.integers(0, 3)]


def lookalike(shape: str, rng: np.random.Generator) -> str:
    """A number of that shape that the rules don't take either."""
    while base_spans(found := filled(shape, rng)):
        pass
    return found


def _variant(kind: int, rng: np.random.Generator) -> str:
    """Personal data as people also write it."""
    if kind == 0:
        return address(ADDRESS_SIGNS[rng.choice(len(ADDRESS_SIGNS), p=SIGN_SHARES)], rng)
    if kind == 1:
        return ".".join(str(x) for x in rng.integers(0, 256, 4))
    if kind == 2:
        d = filled("#" * 15, rng)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = ["", " ", "-", ".", "/"][rng.integers(0, 5)]
        return s.join(d[k : k + 4] for k in range(0, 16, 4))
    return filled(PHONES[rng.choice(len(PHONES), p=PHONE_SHARES)], rng)


def _windows(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    """The classes of a window of the text about one of its triggers, and its tags."""
    where = [m.start() for m in _TRIGGER.finditer(text)]
    if not where:
        return None
    a = max(0, where[rng.integers(0, len(where))] - int(rng.integers(4, WIDTH - 4)))
    tags = np.zeros(len(text), np.int64)
    for s, k, e in spans:
        tags[s:e] = 2 + 2 * k
        tags[s] = 1 + 2 * k
    return encoded(text)[a : a + WIDTH], tags[a : a + WIDTH]


def train(texts: list[str], seed: int = 5, epochs: int = EPOCHS, most: int = WINDOWS) -> Tagger:
    """Adam over windows: as many from the texts' own triggers as there are, the others with a variant or a look-alike put in."""
    rng = np.random.default_rng(seed)
    rows = [w for t in texts[: most // 2] if (w := _windows(t, base_spans(t), rng))]
    contexts = texts or ["the quick brown fox and the lazy dog of the house"]
    shapes = [x for some in LOOKALIKES.values() for x in some]
    while len(rows) < most:
        t, kind = contexts[rng.integers(0, len(contexts))], int(rng.choice(len(KINDS), p=SHARES))
        alike = rng.random() < OTHERS
        cut, new = int(rng.integers(0, len(t) + 1)), lookalike(shapes[rng.integers(0, len(shapes))], rng) if alike else _variant(kind, rng)
        left, right = t[max(0, cut - WIDTH) : cut] + " ", " " + t[cut : cut + WIDTH]
        text = left + new + right
        a = max(0, len(left) - int(rng.integers(4, 40)))
        spans = base_spans(left) + [(len(left), kind, len(left) + len(new))] * (not alike) + [(s + len(left) + len(new), k, e + len(left) + len(new)) for s, k, e in base_spans(right)]
        tags = np.zeros(len(text), np.int64)
        for s, k, e in spans:
            tags[s:e], tags[s] = 2 + 2 * k, 1 + 2 * k
        rows.append((encoded(text)[a : a + WIDTH], tags[a : a + WIDTH]))
    model = Tagger.new(seed)
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for epoch in range(epochs):
        rate = 0.02 * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            part = [rows[i] for i in order[k : k + BATCH]]
            x, y, mask = np.zeros((len(part), WIDTH), np.int64), np.zeros((len(part), WIDTH), np.int64), np.zeros((len(part), WIDTH))
            for r, (codes, tags) in enumerate(part):
                x[r, : len(codes)], y[r, : len(codes)], mask[r, : len(codes)] = codes, tags, 1
            _, grad = model.loss_gradient(x, mask, y)
            size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step += 1
            for name, g in grad.items():
                g = g * min(1.0, 5.0 / max(size, 1e-12))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> Tagger:
    """Learns from pieces of the stretches of a bounded sample: those documents whose ids and texts have the smallest hashes."""
    n = docs.count()
    share = min(1.0, sample / max(n, 1))
    some = id_and_text(docs).withColumn("h", F.xxhash64("doc_id", "text")).where(F.col("h") <= min((1 << 63) - 1, int((2 * share - 1) * (1 << 63))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(h, c, t[c : min(b, c + PIECE)]) for t, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for a, b in stretches(t) for c in range(a, b, PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], ["h", "at", "part"])

    parts = some.mapInArrow(run, "h long, at long, part string").orderBy(F.xxhash64("h", "at"), "h", "at", "part").limit(most).collect()
    return train([r["part"] for r in parts], most=most)


def find(docs: DataFrame, model: Tagger) -> DataFrame:
    """doc_id, the base spans' counts and digest, and all spans of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            rows = []
            for base, added in all_spans(batch.column(1).to_pylist(), shared.value):
                rows.append((*(sum(k == kind for _, kind, _ in base) for k in range(len(KINDS))), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added), len(added)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def personal_data(docs: DataFrame) -> DataFrame:
    return find(docs, fit(docs))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each union of overlapping spans replaced by the kind of its first, as <EMAIL>."""
    out, free = [], 0
    for a, kind, b in sorted(spans):
        if a >= free:
            out += [text[free:a], f"<{KINDS[kind].upper()}>"]
        free = max(free, b)
    return "".join([*out, text[free:]])


def redact(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """docs with personal data replaced in text; n_chars, if there, follows the text; a null text stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, TOGETHER) for whole in batches for k in range(0, whole.num_rows, TOGETHER)):
            old = batch.column(names.index("text")).to_pylist()
            new = [t if t is None else redacted(t, base + added) for t, (base, added) in zip(old, all_spans([t or "" for t in old], shared.value))]
            cols = list(batch.columns)
            cols[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                cols[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in new], pa.int64()).cast(cols[names.index("n_chars")].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)
