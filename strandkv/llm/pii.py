r"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them.

The tagger is trained in numpy from labelled spans. They come from a seeded generator of snippets: invented words with
e-mail addresses, IP addresses, card and phone numbers in many written forms, and with look-alikes (dates, prices,
versions, hexadecimal tokens, digit runs) that are no spans; so nothing of the corpus is needed and every run trains
the same model. All four kinds hold a digit or an at sign (spelled out or not), so the tagger reads the windows of a
text round those and the whole names and hosts beside an at sign, each window once for all its copies in a batch. Windows
overlap; their emissions are combined over the document, each window's say growing with the distance from its edges, and
one Viterbi pass over all of it, outside of all spans where no window lies, gives the tags. Spans are read from those, and
an address of which the tagger found the at sign and a part is taken to the ends of its name and host.

A span that the tagger adds must be well formed of its kind (parts at most 255, Luhn, number of digits) and touch no
base span; base spans always stay.

Cases: null text counts as empty and has no spans; null ids, repeated rows and extra columns pass; texts are read whole,
in time linear in their length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]  # start, end, kind; code points

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:  # the leftmost local part that ends at this sign, then the domain
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c in string.digits for c in m[0]) <= 15:
                    out.append((*m.span(), "phone"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


# --- the tagger

WINDOW, STRIDE, MARGIN = 64, 32, 20
_RISE = np.arange(1, WINDOW + 1, dtype=np.float32)
TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k: first character of kind k; 2 + 2k: a later one
_LETTER, _OTHER, _PAD = 95, 96, 97
SYMBOLS = 98


def coded(text: str) -> np.ndarray:
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    out = np.where((u >= 32) & (u < 127), u - 32, np.where(u >= 0xC0, _LETTER, _OTHER))
    out[(u >= 9) & (u <= 13)] = 0
    return out


def _words(rng: np.random.Generator, n: int) -> str:
    bits = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "io", "le", "ou", "é", "ü", "ñ", "The ", "and ", "at ", "dot ")
    return " ".join("".join(rng.choice(bits) for _ in range(rng.integers(1, 5))) + rng.choice(("", "", "", ",", ".", ":")) for _ in range(n))


def _number(rng: np.random.Generator, n: int) -> str:
    return "".join(str(x) for x in rng.integers(0, 10, n))


def _example(rng: np.random.Generator) -> tuple[str, int]:
    """A string and its kind, -1 for a look-alike."""
    kind = int(rng.integers(-4, len(KINDS)))
    if kind == 0:
        name = _words(rng, 1).strip(" .,:").replace(" ", rng.choice((".", "_", "")))
        host, end = _words(rng, 1).strip(" .,:").replace(" ", ""), rng.choice(("com", "org", "example.com", "net", "de"))
        at, dot = [("@", "."), ("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", ".")][rng.integers(0, 6)]
        return f"{name}{rng.choice(('', str(rng.integers(0, 99))))}{at}{host}{rng.choice(('', str(rng.integers(0, 9))))}{dot}{end}", 0
    if kind == 1:
        return rng.choice((".", ".", ".", "[.]", " . ")).join(str(rng.integers(0, 256)) for _ in range(4)), 1
    if kind == 2:
        body = _number(rng, 15)
        for c in "0123456789":
            if luhn(body + c):
                body += c
                break
        join = rng.choice(("", " ", "-", "."))
        return join.join(body[k : k + 4] for k in range(0, 16, 4)), 2
    if kind == 3:
        a, b, c = _number(rng, 3), rng.choice(("555", _number(rng, 3))), _number(rng, 4)
        return [f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.integers(1, 99)} {a} {b} {c}", f"{a}.{b}.{c}", f"00{rng.integers(10, 99)} {a} {b}{c}"][rng.integers(0, 6)], 3
    return [
        f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 32):02d}", f"${rng.integers(1, 9999)}.{rng.integers(0, 99):02d}", f"v{rng.integers(0, 20)}.{rng.integers(0, 20)}.{rng.integers(0, 20)}",
        "".join(rng.choice(list("0123456789abcdef")) for _ in range(rng.integers(16, 41))), _number(rng, int(rng.integers(1, 13))), f"{rng.integers(1, 13)}:{rng.integers(0, 60):02d}", f"@{_words(rng, 1)}", f"{rng.integers(1, 10**6):,}", f"item{rng.integers(0, 99999)}/{rng.integers(0, 99)}", _number(rng, 20), f"{_number(rng, 5)}-{_number(rng, 4)}",
    ][rng.integers(0, 11)], -1


def labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags."""
    rng = np.random.default_rng(seed)
    x, y = np.full((n, WINDOW), _PAD), np.zeros((n, WINDOW), np.int64)
    for r in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 30:
            filler = _words(rng, int(rng.integers(1, 6))) + " "
            text, tags = text + filler, tags + [0] * len(filler)
            if rng.random() < 0.75:
                s, kind = _example(rng)
                text += s + rng.choice((" ", " ", ". ", ", ", "### ", "\n"))
                tags += ([1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)) if kind >= 0 else [0] * len(s)
                if kind >= 0 and rng.random() < 0.15:  # the same once more
                    i = text.rindex(s)
                    text = text[: i + len(s)] + " " + text[i:]
                    tags += [0] + tags[-len(s) :]
                tags += [0] * (len(text) - len(tags))
        at = int(rng.integers(0, 30))
        m = WINDOW if rng.random() < 0.85 else int(rng.integers(8, WINDOW))
        x[r, :m], y[r, :m] = coded(text[at : at + m]), tags[at : at + m]
    return x, y


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class Tagger:
    """Both directions are rows of the same arrays; a character's row of ``table`` is its part of the gates."""

    def __init__(self, hidden: int = 20, seed: int = 3):
        rng, h = np.random.default_rng(seed), hidden
        self.h = h
        self.p = {
            "table": rng.normal(0, 0.3, (2, SYMBOLS, 4 * h)), "again": rng.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "out": rng.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS)),
            "bias": np.zeros(TAGS), "move": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS),
        }
        self.p["table"][:, :, h : 2 * h] += 1  # remember
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(rows, window, 2 hidden)."""
        n, w, h = len(x), x.shape[1], self.h
        both = np.stack([x, x[:, ::-1]])
        a, c = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        out = np.empty((2, n, w, h), np.float32)
        table, again = self.p["table"], self.p["again"]
        for t in range(w):
            z = a @ again
            z[0] += table[0][both[0, :, t]]
            z[1] += table[1][both[1, :, t]]
            g = _sigmoid(z[..., : 3 * h])
            i, f, o, u = g[..., :h], g[..., h : 2 * h], g[..., 2 * h :], np.tanh(z[..., 3 * h :])
            before = c
            c = f * c + i * u
            tc = np.tanh(c)
            if keep is not None:
                keep.append((a, before, i, f, o, u, tc))
            a = o * tc
            out[:, :, t] = a
        return np.concatenate([out[0], out[1][:, ::-1]], -1)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(rows, window, tags)."""
        return self.states(x) @ self.p["out"] + self.p["bias"]

    def best(self, stretches: list[tuple[np.ndarray, bool, bool]], cells: int = 200_000) -> list[np.ndarray]:
        """The best tags of whole stretches of text, by Viterbi: (emissions, whether the text starts and ends there). What
        lies beside a stretch in its text is outside of all spans."""
        move, out = self.p["move"], [np.empty(0, np.int8)] * len(stretches)
        order = sorted((k for k, s in enumerate(stretches) if len(s[0])), key=lambda k: -len(stretches[k][0]))
        while order:
            w = len(stretches[order[0]][0])
            part, order = order[: max(1, cells // w)], order[max(1, cells // w) :]
            n = np.array([len(stretches[k][0]) for k in part])
            e = np.zeros((w, len(part), TAGS), np.float32)
            for r, k in enumerate(part):
                e[: n[r], r] = stretches[k][0]
            score = e[0] + np.stack([self.p["first"] if stretches[k][1] else move[0] for k in part])
            back = np.zeros((w, len(part), TAGS), np.int8)
            live = np.searchsorted(-n, -np.arange(w), "left")  # rows, longest first, that reach beyond a place
            for t in range(1, w):
                m = live[t]
                s = score[:m, :, None] + move
                back[t, :m] = s.argmax(1)
                score[:m] = s.max(1) + e[t, :m]
            score += np.stack([np.zeros(TAGS, np.float32) if stretches[k][2] else move[:, 0] for k in part])
            tags = np.zeros((w, len(part)), np.int8)
            last = score.argmax(1).astype(np.int8)
            rows = np.arange(len(part))
            tags[n - 1, rows] = last
            for t in range(w - 1, 0, -1):
                m = live[t]
                tags[t - 1, :m] = back[t, rows[:m], tags[t, :m]]
            for r, k in enumerate(part):
                out[k] = tags[: n[r], r].copy()
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        p, h = self.p, self.h
        n, w = x.shape
        keep: list = []
        s = self.states(x, keep)
        e = s @ p["out"] + p["bias"]
        move = p["move"]
        up, down = np.empty((w, n, TAGS), np.float32), np.zeros((w, n, TAGS), np.float32)

        def lse(z: np.ndarray, axis: int) -> np.ndarray:
            m = z.max(axis, keepdims=True)
            return np.log(np.exp(z - m).sum(axis)) + m.squeeze(axis)

        up[0] = p["first"] + e[:, 0]
        for t in range(1, w):
            up[t] = lse(up[t - 1][:, :, None] + move, 1) + e[:, t]
        for t in range(w - 2, -1, -1):
            down[t] = lse(move + (e[:, t + 1] + down[t + 1])[:, None, :], 2)
        total = lse(up[-1], 1)
        d = np.exp(np.swapaxes(up + down, 0, 1) - total[:, None, None])
        rows = np.arange(n)
        pairs = sum(np.exp(up[t][:, :, None] + move + (e[:, t + 1] + down[t + 1])[:, None, :] - total[:, None, None]).sum(0) for t in range(w - 1))
        real = p["first"][y[:, 0]] + e[rows[:, None], np.arange(w), y].sum(1) + move[y[:, :-1], y[:, 1:]].sum(1)
        np.add.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        first = d[:, 0].sum(0) - np.bincount(y[:, 0], minlength=TAGS)
        d[rows[:, None], np.arange(w), y] -= 1
        g = {"move": pairs, "first": first, "out": np.einsum("nwh,nwt->ht", s, d), "bias": d.sum((0, 1))}
        ds = d @ p["out"].T
        ds = np.stack([ds[..., :h], ds[:, ::-1, h:]])
        both = np.stack([x, x[:, ::-1]])
        g["table"], g["again"] = np.zeros_like(p["table"]), np.zeros_like(p["again"])
        da, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        for t in range(w - 1, -1, -1):
            a, before, i, f, o, u, tc = keep[t]
            da = da + ds[:, :, t]
            dc = dc + da * o * (1 - tc * tc)
            dz = np.concatenate([dc * u * i * (1 - i), dc * before * f * (1 - f), da * tc * o * (1 - o), dc * i * (1 - u * u)], -1)
            g["again"] += np.swapaxes(a, 1, 2) @ dz
            for k in (0, 1):
                np.add.at(g["table"][k], both[k, :, t], dz[k])
            da, dc = dz @ np.swapaxes(p["again"], 1, 2), dc * f
        return float((total - real).mean()), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 48, rate: float = 0.02, seed: int = 4) -> float:
        rng = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            part = rng.integers(0, len(x), batch)
            loss, g = self.gradients(x[part], y[part])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            now = rate * (1 - 0.9 * step / steps)
            for k, a in g.items():
                a = (a * min(1, 5 / norm)).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
        return loss


@lru_cache
def trained(steps: int = 300, examples: int = 1500, seed: int = 11) -> Tagger:
    tagger = Tagger()
    tagger.train(*labelled(examples, seed), steps)
    return tagger


_TRIGGER = re.compile(r"[0-9][0-9 ().-]*|@|[(\[]at[)\]]", re.I)
_AT = re.compile(r"@|[(\[]at[)\]]", re.I)
_HOST = re.compile(r" ?[\w-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[\w-]++)*+", re.I)
_MORE_HOST = re.compile(r"[\w-]*+(?:(?:\.| ?[(\[]dot[)\]] ?)[\w-]++)*+", re.I)


def _name_start(text: str, at: int) -> int:
    """Where the run of characters of a local part that ends at ``at`` begins."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.%+-"):
        at -= 1
    return at


def windows(text: str) -> list[int]:
    """Starts of the overlapping windows round all digits, at signs and spelled-out ones in brackets, with the whole
    local part and host beside a sign."""
    groups: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = m.span()
        if not "0" <= m[0][0] <= "9":
            a = _name_start(text, a - (a > 0 and text[a - 1] == " "))
            host = _HOST.match(text, b)
            b = host.end() if host else b
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        while groups and a <= groups[-1][1]:
            lo, hi = groups.pop()
            a, b = min(a, lo), max(b, hi)
        groups.append((a, b))
    return [w for lo, hi in groups for w in _cover(lo, hi)]


def _cover(lo: int, hi: int) -> list[int]:
    return list(range(lo, max(lo + 1, hi - WINDOW + STRIDE), STRIDE))


def _well_formed(s: str, kind: str) -> bool:
    digits = "".join(c for c in s if c in string.digits)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[(\[]at[)\]]) ?[\w-]+( ?([.]|[(\[]dot[)\]]) ?[\w-]+)+", s, re.I))
    if kind == "ip":
        parts = re.fullmatch(r"(\d{1,3}) ?\[?\.\]? ?(\d{1,3}) ?\[?\.\]? ?(\d{1,3}) ?\[?\.\]? ?(\d{1,3})", s, re.A)
        return bool(parts) and all(int(x) <= 255 for x in parts.groups())
    if kind == "card":
        return bool(re.fullmatch(r"[\d .-]+", s, re.A)) and 14 <= len(digits) <= 19 and luhn(digits)
    return bool(re.fullmatch(r"[+(]?\d[\d ().-]+\d", s, re.A)) and 9 <= len(digits) <= 15 and bool(re.search(r"[ ().-]|^\+", s))


def _spans(text: str, at: np.ndarray, tags: np.ndarray) -> list[Span]:
    """Runs of tags at rising positions; a gap or another kind ends a run."""
    out: list[Span] = []
    start = end = kind = -1

    def close() -> None:
        a, b = start, end
        while a < b and text[a] in " \t\n,;:":
            a += 1
        while a < b and text[b - 1] in " \t\n,;:.":
            b -= 1
        at_sign = _AT.search(text, a, b) if KINDS[kind] == "email" else None
        if at_sign:  # names and hosts longer than a window sees are taken whole
            left = _name_start(text, a)
            while left < a and not text[left].isalnum():
                left += 1
            a, b = left, max(b, _MORE_HOST.match(text, b).end())
        # a neighbour of the same make belongs to the number too, so a part of a longer one is no span
        whole = (a == 0 or not text[a - 1].isalnum()) and (b == len(text) or not text[b].isalnum())
        if whole and _well_formed(text[a:b], KINDS[kind]) and (not out or a >= out[-1][1]):
            out.append((a, b, KINDS[kind]))

    for i, tag in zip(at.tolist(), tags.tolist()):
        k = (tag - 1) // 2 if tag else -1
        if start >= 0 and (k != kind or i != end or tag % 2):
            close()
            start = -1
        if k >= 0:
            if start < 0:
                start, kind = i, k
            end = i + 1
    if start >= 0:
        close()
    return out


def added_spans(texts: list[str], bases: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """Well-formed spans of the tagger that touch no base span, text by text."""
    number: dict[str, int] = {}
    need: list[list[tuple[int, int]]] = []
    for text in texts:
        need.append([(a, number.setdefault(text[a : a + WINDOW], len(number))) for a in windows(text)])
    if not number:
        return [[] for _ in texts]
    x = np.full((len(number), WINDOW), _PAD)
    for s, k in number.items():
        x[k, : len(s)] = coded(s)
    e = np.concatenate([tagger.emissions(x[k : k + 2048]) for k in range(0, len(x), 2048)])
    # windows that follow each other cover one stretch; where they overlap, a window's say grows with the distance from
    # its edges, beyond which it sees nothing
    places, stretches = [], []
    for number_, (text, at) in enumerate(zip(texts, need)):
        k = 0
        while k < len(at):
            m = k + 1
            while m < len(at) and at[m][0] - at[m - 1][0] <= WINDOW:
                m += 1
            lo, hi = at[k][0], min(len(text), at[m - 1][0] + WINDOW)
            total, weight = np.zeros((hi - lo, TAGS), np.float32), np.zeros((hi - lo, 1), np.float32)
            for a, w in at[k:m]:
                n = min(WINDOW, hi - a)
                say = np.minimum(_RISE[:n] if a else WINDOW, _RISE[:n][::-1] if a + n < len(text) else WINDOW)
                say = np.broadcast_to(say, n)[:, None]
                total[a - lo : a - lo + n] += say * e[w, :n]
                weight[a - lo : a - lo + n] += say
            places.append((number_, lo))
            stretches.append((total / weight, lo == 0, hi == len(text)))
            k = m
    best: list[list[Span]] = [[] for _ in texts]
    for (k, lo), tags in zip(places, tagger.best(stretches)):
        best[k] += _spans(texts[k], np.arange(lo, lo + len(tags)), tags)
    return [[s for s in found if all(s[1] <= b[0] or s[0] >= b[1] for b in base)] for found, base in zip(best, bases)]


def find(texts: list[str], tagger: Tagger) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans, and all spans, of each text."""
    bases = [base_spans(t) for t in texts]
    added = added_spans(texts, bases, tagger)
    return bases, [sorted({*b, *a}, key=lambda s: (s[0], KINDS.index(s[2]))) for b, a in zip(bases, added)]


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of spans that overlap, replaced by <KIND> of its first."""
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, tagger: Tagger | None = None, id_col: str = "doc_id", text_col: str = "text", masked: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, all spans (and masked_text).

    carry: string columns of ``docs`` that the result keeps.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((tagger or trained()).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger()
        own.p = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            bases, spans = find(texts, own)
            cols = [b.column(0), *(pa.array([sum(s[2] == k for s in x) for x in bases], pa.int64()) for k in KINDS)]
            cols += [pa.array([hashlib.sha256(_digest(x).encode()).hexdigest() for x in bases]), pa.array([_digest(x) for x in spans], pa.string())]
            if masked:
                cols.append(pa.array([mask(t, s) for t, s in zip(texts, spans)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols + b.columns[2:], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"] + ["masked_text"] * masked + list(carry)
    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string" + ", masked_text string" * masked + "".join(f", `{c}` string" for c in carry)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, kind)
