"""Personal data by a semi-Markov conditional random field.

A text's tokens are cut into segments of 1 to MAX_LEN tokens. Each segment that could be personal data is
scored per type from features of the whole span (shape, check digits, cue words before it); all others
are O tokens of one token. Dynamic programming over boundaries and types at once, with bounded segment
lengths, gives the best segmentation. Weights maximise the conditional likelihood of generated,
labelled sentences; training is exact (forward-backward), seeded and takes a few seconds on the driver.

Tokens end at white space and at punctuation that no shape has within itself (= , ; | < > quotes and the like),
also at ``:`` and ``/``, and between a digit and a letter beyond ASCII; so data glued to keys, tags or commas has
bounds of its own. A segment is personal data only if it matches a shape and holds an anchor (a digit, an
``@`` or an at-marker). Tokens that no such segment covers are O for certain, so decoding runs over the
others alone, stretch by stretch, and gives what decoding of the whole text gives. Nothing limits a segment but
MAX_LEN. The plain patterns (BASE) always stay; the field adds spans that overlap none of them. Card-like numbers that fail the check digits may be tagged too: a mistyped card is one.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, small_batches

BASE = ("email", "ip", "card", "phone")
TYPES = ("O", "email", "ip", "card", "phone", "ssn", "iban", "mac")
KINDS = TYPES[1:]
MAX_LEN = 8

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]", re.I)
TOKEN = re.compile(r"[^\s=:,;|<>\"'`{}&\\*#~^!?/$，：；。、“”‘’「」]+")
#: Between a digit and a letter beyond ASCII, where texts without blanks have a word's end.
EDGE = re.compile(r"(?<=[0-9])(?=[^\x00-\x7f])|(?<=[^\x00-\x7f])(?=[+0-9])")
#: What may stand between two tokens of a segment.
GLUE = ("", " ", ":", "/")
#: Tokens before the first anchor of a window and after its last, so that every candidate and its cues lie within.
BEFORE, AFTER = MAX_LEN + 3, 2 * MAX_LEN + 4


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def small_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, in linear time: a match's @ is the first
    after its start, so each @ is tried once with the run of local characters before it."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        pos = m.end() if m else at + 1
        at = text.find("@", pos)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The plain patterns' spans, by kind, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if small_parts(m[0])]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


#: Words before a span that point to a type.
CUES = {
    "phone": {"tel", "phone", "call", "fax", "mobile", "cell", "telephone", "whatsapp"},
    "ssn": {"ssn", "social", "security"},
    "iban": {"iban", "account", "bank"},
    "card": {"card", "visa", "mastercard", "amex", "credit"},
    "email": {"email", "mail", "e-mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server"},
}
SHAPES = {
    "ssn": re.compile(r"\d{3}[- ]\d{2}[- ]\d{4}"),
    "national": re.compile(r"\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}"),
    "plus": re.compile(r"(\+|00)\d[\d ().-]{6,22}\d"),
    "email": re.compile(r"[\w.%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "spelled": re.compile(r"[\w.%+-]+ ?[(\[]at[)\]] ?[A-Za-z0-9-]+( ?([(\[]dot[)\]]|\.) ?[A-Za-z0-9-]+)+", re.I),
    "iban": re.compile(r"[A-Z]{2}\d{2}( ?[A-Z0-9]){11,30}"),
    "dotted": re.compile(r"\d+(\.\d+)+"),
    "mac": re.compile(r"[0-9A-Fa-f]{2}([:-][0-9A-Fa-f]{2}){5}"),
    "date": re.compile(r"\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}"),
    "clock": re.compile(r"\d{1,2}:\d{2}(:\d{2})?"),
    "bare": re.compile(r"\d{9,12}"),
    "cardlike": re.compile(r"\d{4}([ -]?\d{4}){2}[ -]?\d{1,7}|\d{13,19}|\d{4} \d{6} \d{5}"),
}
N_FEATURES = 1 + len(SHAPES) + 6 + len(CUES) * 2 + MAX_LEN
TRIM = ".,;:!?'\")]}>|"


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(s: str, nd: int, n_tokens: int, cue: set[str]) -> list[float] | None:
    """The feature vector of a span with ``nd`` digits; None for a span that can't be personal data at all."""
    if nd < 6 and "@" not in s and "." not in s and ":" not in s and "-" not in s and "(" not in s and "[" not in s:
        return None
    hit = {k: bool(r.fullmatch(s)) for k, r in SHAPES.items()}
    if not any(hit.values()) or nd < 6 and not (hit["email"] or hit["spelled"] or hit["dotted"] or hit["mac"]):
        return None
    ok_card = hit["cardlike"] and 13 <= nd <= 19 and luhn(digits(s))
    ok_iban = hit["iban"] and iban_valid(s)
    ok_ip = hit["dotted"] and s.count(".") == 3 and small_parts(s)
    x = [1.0, *hit.values(), ok_card, ok_iban, ok_ip, nd > 15, nd < 9, any(c.isalpha() for c in s)]
    known = any(hit[k] for k in ("ssn", "national", "plus", "email", "spelled", "iban", "mac", "cardlike", "bare"))
    for k, words in CUES.items():
        has = bool(cue & words)
        x += [has, has and known]
    x += [n_tokens == i + 1 for i in range(MAX_LEN)]
    return x


def tokens_of(text: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int]]:
    for m in TOKEN.finditer(text, start, len(text) if end is None else end):
        a, b = m.span()
        if not (w := m[0]).isascii():
            for e in EDGE.finditer(w):
                yield a, m.start() + e.start()
                a = m.start() + e.start()
        yield a, b


def start_before(text: str, at: int) -> int:
    """Where the BEFORE-th token before the one that holds position ``at`` begins (0 if there are fewer)."""
    reach = 128
    while True:
        lo = max(0, at - reach)
        before = list(tokens_of(text, lo, at))
        if lo and before and before[0][0] == lo:
            del before[0]  # it may be cut
        if len(before) > BEFORE:
            return before[-BEFORE - 1][0]
        if not lo:
            return 0
        reach *= 2


def windows(text: str) -> Iterator[tuple[list[tuple[int, int]], bool]]:
    """(tokens, whether the text has more after them) of the stretches round anchors. Between two windows, and in
    the first and last tokens of one inside the text, no candidate lies."""
    anchors = [m.start() for m in ANCHOR.finditer(text)]
    k = 0
    while k < len(anchors):
        tokens, left, seen, more = [], AFTER, False, False
        for t in tokens_of(text, start_before(text, anchors[k])):
            if left == 0:
                more = True
                break
            tokens.append(t)
            j = bisect_left(anchors, t[1], k)
            if j > k:
                k, left, seen = j, AFTER, True
            elif seen:
                left -= 1
        yield tokens, more


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, int, list[float]]]:
    """(first token, number of tokens, start, end, features) of the segments that may be personal data."""
    words = [text[a:b] for a, b in tokens]
    low = [w.strip(TRIM + "([{<").lower() for w in words]
    near = [bool(ANCHOR.search(w)) for w in words]
    # digits up to each token, and the next token that has an anchor
    upto, nxt = [0], [len(tokens)] * (len(tokens) + 1)
    for w in words:
        upto.append(upto[-1] + len(DIGITS.findall(w)))
    for i in range(len(tokens) - 1, -1, -1):
        nxt[i] = i if near[i] else nxt[i + 1]
    out = []
    for i, (start, stop) in enumerate(tokens):
        if nxt[i] - i >= MAX_LEN:
            continue
        cue = set(low[max(0, i - 3) : i])
        while start < stop and text[start] == "[":
            start += 1
        starts = [start] if text[start] != "(" else [start, start + 1] if text[start + 1 : start + 2].isdigit() else [start + 1]
        for n in range(1, min(MAX_LEN, len(tokens) - i) + 1):
            last = tokens[i + n - 1]
            if n > 1 and text[tokens[i + n - 2][1] : last[0]] not in GLUE:
                break
            if nxt[i] >= i + n:
                continue
            end = last[1]
            while end > last[0] and text[end - 1] in TRIM:
                end -= 1
            for a in starts:
                if end > max(a, last[0]) and (x := features(text[a:end], upto[i + n] - upto[i], n, cue)) is not None:
                    out.append((i, n, a, end, x))
    return out


def decode(n_tokens: int, cands: list, weights: np.ndarray, trans: np.ndarray, more: bool = False) -> list[tuple[str, int, int]]:
    """The best segmentation by dynamic programming: best[t, y] is the score of the best one of the first t
    tokens whose last segment has type y. Before the tokens stands O, and so it does after them if there
    are ``more``."""
    ny = len(TYPES)
    best, source, before = np.full((n_tokens + 1, ny), -np.inf), np.full((n_tokens + 1, ny), -1), np.zeros((n_tokens + 1, ny), int)
    best[0, 0] = 0
    at: dict[int, list[int]] = {}
    for k, c in enumerate(cands):
        at.setdefault(c[0] + c[1], []).append(k)
    scores = (np.array([c[4] for c in cands], float) @ weights)[:, 1:] if cands else np.zeros((0, ny - 1))
    for t in range(1, n_tokens + 1):
        into = best[t - 1] + trans[:, 0]
        before[t, 0] = p = into.argmax()
        best[t, 0] = into[p]
        for k in at.get(t, ()):
            into = best[cands[k][0]][:, None] + trans[:, 1:]
            p = into.argmax(0)
            score = into[p, np.arange(ny - 1)] + scores[k]
            won = np.flatnonzero(score > best[t, 1:])
            best[t, won + 1], source[t, won + 1], before[t, won + 1] = score[won], k, p[won]
    out, t, y = [], n_tokens, int((best[n_tokens] + (trans[:, 0] if more else 0)).argmax())
    while t:
        k, py = int(source[t, y]), int(before[t, y])
        if y:
            c = cands[k]
            out.append((TYPES[y], c[2], c[3]))
            t = c[0]
        else:
            t -= 1
        y = py
    return out[::-1]


def field_spans(text: str, model: tuple[np.ndarray, np.ndarray]) -> list[tuple[str, int, int]]:
    """The field's spans, from left to right: stretches of tokens that candidates cover are decoded each by itself."""
    out = []
    for tokens, more in windows(text):
        held: list = []
        upto = 0
        for c in [*candidates(text, tokens), None]:
            if held and (c is None or c[0] >= upto + 1):
                first = held[0][0]
                out += decode(upto - first, [(i - first, *rest) for i, *rest in held], *model, more or upto < len(tokens))
                held = []
            if c is not None:
                upto = max(upto if held else 0, c[0] + c[1])
                held.append(c)
    return out


def all_spans(text: str, base: list[tuple[str, int, int]], model) -> list[tuple[str, int, int]]:
    """Base spans and those of the field that overlap none of them, by kind, then start."""
    found = field_spans(text, model)
    if found and base:
        # base spans of different kinds may overlap: what they cover together, as disjoint stretches
        covered: list[list[int]] = []
        for _, a, b in sorted(base, key=lambda s: s[1]):
            if covered and a < covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], b)
            else:
                covered.append([a, b])
        begins, ends = [c[0] for c in covered], [c[1] for c in covered]
        found = [s for s in found if (k := bisect_left(begins, s[2])) == 0 or ends[k - 1] <= s[1]]
    return sorted([*base, *found], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


# --- training -------------------------------------------------------------------------------------


def _card(r: random.Random) -> str:
    d = "4" + "".join(r.choice("0123456789") for _ in range(14))
    d += next(c for c in "0123456789" if luhn(d + c))
    return r.choice([d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))])


def _iban(r: random.Random) -> str:
    body = "".join(r.choice("0123456789") for _ in range(18))
    check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
    s = f"DE{check:02d}{body}"
    return r.choice([s, " ".join(s[i : i + 4] for i in range(0, len(s), 4))])


def _num(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def labelled_sentence(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A generated sentence with its labelled spans; decoys have none."""
    word = lambda: "".join(r.choice("aeiounrstlm") for _ in range(r.randint(2, 8)))
    make = {
        "email": lambda: r.choice([f"{word()}.{word()}@{word()}.com", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org", f"{word()} [at] {word()}.net"]),
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "card": lambda: _card(r),
        "phone": lambda: r.choice([f"({_num(r, 3)}) {_num(r, 3)}-{_num(r, 4)}", f"{_num(r, 3)}-{_num(r, 3)}-{_num(r, 4)}", f"+{r.randint(1, 99)} {_num(r, 3)} {_num(r, 3)} {_num(r, 3)}", f"+1 ({_num(r, 3)}) {_num(r, 3)}-{_num(r, 4)}", f"{_num(r, 3)}.{_num(r, 3)}.{_num(r, 4)}"]),
        "ssn": lambda: f"{_num(r, 3)}-{_num(r, 2)}-{_num(r, 4)}",
        "iban": lambda: _iban(r),
        "mac": lambda: ":".join(f"{r.randint(0, 255):02x}" for _ in range(6)),
    }
    decoys = [
        lambda: f"{r.randint(1, 20)}.{r.randint(0, 9)}.{r.randint(0, 30)}", lambda: f"20{_num(r, 2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 28)}/{r.randint(1, 12)}/20{_num(r, 2)}", lambda: f"{r.randint(10, 23)}:{r.randint(10, 59)}", lambda: f"${_num(r, 3)},{_num(r, 3)}.{_num(r, 2)}",
        lambda: _num(r, r.randint(6, 12)), lambda: f"No. {_num(r, 8)}", lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40]))),
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"{_num(r, 4)} {_num(r, 4)}", lambda: f"978-{_num(r, 1)}-{_num(r, 3)}-{_num(r, 5)}-{_num(r, 1)}",
        lambda: f"{r.randint(256, 999)}.{r.randint(256, 999)}.{_num(r, 3)}.{_num(r, 3)}", lambda: f"@{word()}{_num(r, 3)}", lambda: f"token = \"{''.join(r.choice('0123456789abcdef') for _ in range(40))}\"", lambda: f"{_num(r, 5)}-{_num(r, 4)}",
    ]
    def glued(key: str) -> tuple[str, str]:
        """What stands on either side of a value in key-value lines, tables, tags and JSON."""
        k = r.choice([*sorted(CUES.get(key, ())), key, word()])
        return r.choice([(f"{k}=", ";"), (f"{k}:", ""), (f"{word()},", f",{word()}"), (f"<{k}>", f"</{k}>"), (f'"{k}":"', '"'), (f"({k}) ", ""), (f"|{word()}|", "|"), (f"{k}='", "'"), (f"{word()}/", "")])

    text, spans = word(), []
    for _ in range(r.randint(1, 3)):
        text += "".join(" " + word() for _ in range(r.randint(1, 4))) + " "
        if r.random() < 0.55:
            kind = r.choice(KINDS)
            if r.random() < 0.4 and kind in CUES:
                text += r.choice(sorted(CUES[kind])) + r.choice([": ", " "])
            s = make[kind]()
            a, b = glued(kind) if r.random() < 0.3 else ("", "")
            text += a
            spans.append((kind, len(text), len(text) + len(s)))
            s += b
        else:
            s = r.choice(decoys)()
            if r.random() < 0.3:
                a, b = glued(r.choice(["id", "ref", "date", "code"]))
                s = a + s + b
        text += s + r.choice(["", ".", ","])
    return text + " " + word(), spans


def likelihood(batch: list, steps: int, weights: np.ndarray, trans: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Summed log-likelihood and its gradients. batch: per sentence (number of tokens, gold labels by
    candidate, candidates by (first, n)) with x holding all candidates' features; exact forward-backward."""
    score, ny = x @ weights, len(TYPES)
    total, gs, gt = 0.0, np.zeros_like(score), np.zeros_like(trans)
    lse = lambda a, axis=None: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis)) if axis is not None else a.max() + np.log(np.exp(a - a.max()).sum())
    for n, cands, gold_steps in batch:
        fwd, bwd = np.full((n + 1, ny), -1e30), np.full((n + 1, ny), -1e30)
        fwd[0, 0], bwd[n] = 0, 0
        by_end: dict[int, list] = {}
        by_start: dict[int, list] = {}
        for c in cands:
            by_end.setdefault(c[0] + c[1], []).append(c)
            by_start.setdefault(c[0], []).append(c)
        for t in range(1, n + 1):
            fwd[t, 0] = lse(fwd[t - 1] + trans[:, 0])
            for i, _, k in by_end.get(t, ()):
                fwd[t, 1:] = np.logaddexp(fwd[t, 1:], lse(fwd[i][:, None] + trans[:, 1:], 0) + score[k, 1:])
        for t in range(n - 1, -1, -1):
            acc = bwd[t + 1, 0] + trans[:, 0]
            for i, m, k in by_start.get(t, ()):
                acc = np.logaddexp(acc, lse(trans[:, 1:] + (bwd[i + m, 1:] + score[k, 1:])[None, :], 1))
            bwd[t] = acc
        z = lse(fwd[n])
        gold = 0.0
        for t in range(n):
            gt[:, 0] -= np.exp(fwd[t] + trans[:, 0] + bwd[t + 1, 0] - z)
        for i, m, k in cands:
            p = np.exp(fwd[i][:, None] + trans[:, 1:] + (score[k, 1:] + bwd[i + m, 1:])[None, :] - z)
            gt[:, 1:] -= p
            gs[k, 1:] -= p.sum(0)
        for py, y, k in gold_steps:
            gold += trans[py, y] + (score[k, y] if k is not None else 0)
            gt[py, y] += 1
            if k is not None:
                gs[k, y] += 1
        total += gold - z
    return total, x.T @ gs, gt


def prepared(sentences: list) -> tuple[list, np.ndarray]:
    batch, rows = [], []
    for text, spans in sentences:
        tokens = list(tokens_of(text))
        cands, index = [], {}
        for i, n, a, b, f in candidates(text, tokens):
            index[a, b] = (i, n, len(rows))
            cands.append((i, n, len(rows)))
            rows.append(f)
        gold, t, py = [], 0, 0
        todo = {index[a, b][0]: (index[a, b], TYPES.index(k)) for k, a, b in spans if (a, b) in index}
        while t < len(tokens):
            (_, n, k), y = todo.get(t, ((t, 1, None), 0))
            gold.append((py, y, k))
            t, py = t + n, y
        batch.append((len(tokens), cands, gold))
    return batch, np.array(rows)


@lru_cache(maxsize=4)
def trained(n_sentences: int = 250, rounds: int = 25, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions), fitted on ``n_sentences`` generated sentences by RProp-like ascent with an L2 term."""
    r = random.Random(seed)
    batch, x = prepared([labelled_sentence(r) for _ in range(n_sentences)])
    w, t = np.zeros((x.shape[1], len(TYPES))), np.zeros((len(TYPES), len(TYPES)))
    sw, st, ow, ot = np.full_like(w, 0.1), np.full_like(t, 0.1), np.zeros_like(w), np.zeros_like(t)
    for _ in range(rounds):
        _, gw, gt = likelihood(batch, rounds, w, t, x)
        for p, g, s, o in ((w, gw - 0.1 * w, sw, ow), (t, gt - 0.1 * t, st, ot)):
            s *= np.where(g * o > 0, 1.3, np.where(g * o < 0, 0.5, 1))
            np.clip(s, 1e-4, 1.0, out=s)
            p += np.sign(g) * s
            o[:] = g
    return w, t


# --- operators ------------------------------------------------------------------------------------


def personal_data(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, base, spans) per row of ``docs`` (doc_id, text; other columns are ignored): arrays of
    struct<kind, start, end> in code points, end exclusive, by kind in the order of KINDS, then start.
    A null or empty text has no spans; a null doc_id stays null; repeated rows are treated alike."""
    model = model or trained()
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in pieces(batches):
            bases, spans = [], []
            for t in batch.column(1).to_pylist():
                b = base_spans(t) if t and ANCHOR.search(t) else []
                bases.append([{"kind": k, "start": x, "end": y} for k, x, y in b])
                spans.append([{"kind": k, "start": x, "end": y} for k, x, y in all_spans(t, b, model)] if t and ANCHOR.search(t) else [])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kind), pa.array(spans, kind)], names=["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by its first span's kind in brackets."""
    out, at, todo = [], 0, sorted(spans, key=lambda s: (s[1], s[2]))
    i = 0
    while i < len(todo):
        kind, a, b = todo[i]
        while i + 1 < len(todo) and todo[i + 1][1] < b:
            i += 1
            b = max(b, todo[i][2])
        out += [text[at:a], f"[{kind.upper()}]"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by markers; all columns stay, n_chars follows the
    new text where that column exists. Null texts stay null."""
    model = model or trained()
    small_batches(docs.sparkSession)
    fields = docs.schema

    def run(batches):
        for batch in pieces(batches):
            texts = []
            for t in batch.column("text").to_pylist():
                texts.append(redact(t, all_spans(t, base_spans(t), model)) if t and ANCHOR.search(t) else t)
            i = batch.schema.get_field_index("text")
            batch = batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))
            if (j := batch.schema.get_field_index("n_chars")) >= 0:
                batch = batch.set_column(j, batch.schema.field(j), pa.array([None if t is None else len(t) for t in texts], batch.schema.field(j).type))
            yield batch

    return docs.mapInArrow(run, fields)
