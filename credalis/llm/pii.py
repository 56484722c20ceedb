"""Personal data: exact patterns, and a linear-chain conditional random field that adds what they miss.

The patterns find the base spans. The random field labels words by their shape and neighbourhood. A word without a digit,
``@`` or a bracketed "at" or "dot", and not beside such brackets, can only be outside a span, so decoding falls apart at
such words into zones, which Viterbi decodes in numpy batches of equal length without changing the result for the whole
text. Its weights are trained by gradient ascent on a small labelled table made here from sentence patterns. It adds
national phone numbers, numbers that stand beside each other, disguised addresses, and secrets (keys, passwords). A span
that it adds must hold up as its kind (digits, check sum, octets) and touch no base span.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credalis.llm.store import table

KINDS = ("email", "ip", "card", "phone")
#: Found by the random field alone, and listed apart.
SECRET = "secret"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUES = re.compile(r"[0-9@]|[\[({](?:at|dot)[\])}]", re.I)
_BRACKETED = re.compile(r"[\[({](at|dot)[\])}]", re.I)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NEXT = re.compile(r"[\x20\x09]{1,2}([^\x20\x09-\x0D]+)")
_KEY = re.compile(r"[A-Za-z0-9_+/-]{12,}=*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def holds(kind: str, s: str) -> bool:
    """Whether a text can be of that kind."""
    d = _digits(s)
    if kind == "email":
        at = [m for m in _BRACKETED.finditer(s) if m[1].lower() == "at"]
        return s.count("@") + len(at) == 1 and (at[0].start() if at else s.index("@")) > 0 and s[-1].isalnum()
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(int(p) <= 255 for p in (q[-4:] if len(q) < 5 else "999" for q in parts))
    if kind == SECRET:
        return bool(_KEY.fullmatch(s)) and bool(d) and any(c.isalpha() for c in s)
    if any(c.isalpha() for c in s):
        return False
    return 13 <= len(d) <= 19 and luhn(d) if kind == "card" else 9 <= len(d) <= 15


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches. A local part holds no ``@``, so each ``@`` is tried once, with the longest run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            end = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The pattern matches that hold, by kind and then start; code points, end exclusive."""
    out = list(emails(text))
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() - m[0].count(" ") - m[0].count("-") <= 19 and luhn(_digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


# --- the random field ---------------------------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in (*KINDS, SECRET) for p in "BI"))
_NEVER = -1e4


def shape(word: str) -> str:
    """Letters as a, digits as d with their number (up to 6), other signs as they are; runs of letters once."""
    return re.sub("[0-9]+", lambda m: f"d{min(6, m.end() - m.start())}", re.sub(r"[^\W\d_]+", "a", word))


def word_features(word: str, before: str, after: str, place: int, size: int) -> list[str]:
    n = len(_digits(word))
    core = word.strip("()[]<>{}\"',;:.!?")
    key, _, value = core.rpartition("=")
    value = value.strip("\"'")
    turns = len(re.findall(r"[0-9](?=[^\W\d_])", value))
    dressed = _BRACKETED.search(word)
    return [
        "bias", f"shape={shape(core)}", f"n={min(n, 20)}", f"n/4={n // 4}", f"at={'@' in word}", f"plus={word.startswith('+')}", f"paren={word[:1] == '('}",
        f"dots={min(core.count('.'), 4)}", f"dashes={min(core.count('-'), 4)}", f"alpha={any(c.isalpha() for c in word)}", f"all={core.isdigit()}", f"luhn={13 <= n <= 19 and luhn(_digits(word))}",
        f"before={shape(before) if any(c.isdigit() for c in before) else before.lower().strip('.,:;()')[:10]}", f"after={shape(after) if any(c.isdigit() for c in after) else ''}",
        f"first={place == 0}", f"size={min(size, 6)}", f"turns={min(turns, 4)}", f"long={min(len(value) // 6, 4)} {bool(n) and value.isalnum()} {turns > 1}", f"key={key.lower()[-8:]}", f"upper={value.isupper() and n > 0}",
        f"dressed={dressed[1].lower() if dressed else ''} {bool(dressed) and dressed.end() - dressed.start() == len(word)}", f"by={bool(_BRACKETED.fullmatch(before))} {bool(_BRACKETED.fullmatch(after))}",
    ]


def allowed() -> np.ndarray:
    """Transitions: an inside label follows only its own kind."""
    t = np.zeros((len(LABELS), len(LABELS)))
    for j, b in enumerate(LABELS):
        if b.startswith("I-"):
            for i, a in enumerate(LABELS):
                if a[2:] != b[2:]:
                    t[i, j] = _NEVER
    return t


_BARRED = allowed()


class ShapeField:
    """A linear-chain conditional random field over zones of words; zones are bounded by outside words on both sides."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, start: np.ndarray):
        self.names, self.weights, self.moves, self.start = names, weights, moves, start

    def emissions(self, zone: list[list[int]]) -> np.ndarray:
        return np.stack([self.weights[f].sum(0) for f in zone])

    def ids(self, zone: list[tuple[str, str, str]]) -> list[list[int]]:
        n = len(zone)
        return [[self.names[f] for f in word_features(w, a, b, i, n) if f in self.names] for i, (w, a, b) in enumerate(zone)]

    def decode(self, zones: list[list[tuple[str, str, str]]]) -> list[list[str]]:
        """The best labels of each zone: Viterbi over all zones of one length at once."""
        out: list[list[str]] = [[] for _ in zones]
        by_length = defaultdict(list)
        for i, z in enumerate(zones):
            by_length[len(z)].append(i)
        for n, which in by_length.items():
            for lo in range(0, len(which), max(1, 20_000 // n)):
                part = which[lo : lo + max(1, 20_000 // n)]
                e = np.stack([self.emissions(self.ids(zones[i])) for i in part])
                best = e[:, 0] + self.start
                back = np.zeros((len(part), n, len(LABELS)), np.int8)
                for t in range(1, n):
                    total = best[:, :, None] + self.moves
                    back[:, t] = total.argmax(1)
                    best = total.max(1) + e[:, t]
                state = best.argmax(1)
                path = [state]
                for t in range(n - 1, 0, -1):
                    state = back[np.arange(len(part)), t, state]
                    path.append(state)
                for i, row in zip(part, np.stack(path[::-1], 1).tolist(), strict=True):
                    out[i] = [LABELS[s] for s in row]
        return out


def labelled_table(per_pattern: int = 6, seed: int = 5) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences as ``(word, label)``. Marked values are invented from number ranges kept for examples."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda signs, n: "".join(signs[i] for i in rng.integers(0, len(signs), n))
    mixed = lambda signs, n: pick(signs, n - 3) + num(1) + pick("abcdef" if signs[-1].islower() else "ABCDEF", 1) + num(1)
    hexed = lambda n: mixed("0123456789abcdef", n)

    def card(groups: str) -> list[str]:
        body = "4" + num(14)
        body += next(str(d) for d in range(10) if luhn(body + str(d)))
        return [body[i : i + 4] for i in range(0, 16, 4)] if groups == " " else [groups.join(body[i : i + 4] for i in range(0, 16, 4))]

    values = {
        "phone": lambda: [[f"+{num(2)}", num(3), f"555{num(4)}"], ["+1", f"({num(3)})", f"555-{num(4)}"], [f"({num(3)})", f"555-{num(4)}"], [f"{num(3)}-555-{num(4)}"], [f"0{num(3)}", f"555{num(4)}"], [f"00{num(2)}", num(3), num(3), num(4)], [f"{num(3)}.555.{num(4)}"], [f"0{num(3)}/{num(7)}"], [f"0{num(1)}", num(2), num(2), num(2), num(2)], [num(3), "555", num(4)]],
        "card": lambda: [card(" "), card("-"), card(""), card(".")],
        "ip": lambda: [[f"{rng.integers(0, 256)}.{rng.integers(0, 256)}.{rng.integers(0, 256)}.{rng.integers(0, 256)}"], [f"10.0.{rng.integers(0, 256)}.{rng.integers(0, 256)}:80{num(2)}"]],
        "email": lambda: [[f"ann{num(2)}@mail.example.com"], [f"<b.lee@example{num(1)}.org>"], [f"info{num(1)}@example"], ["sue", "[at]", "example.org"], ["lee", "(at)", "mail", "(dot)", "example"], ["kim[at]example.net"], ["max(at)example[dot]com"], ["team", "{at}", "example", "[dot]", "org"]],
        SECRET: lambda: [[f"password={hexed(rng.integers(14, 22))}"], [f"{hexed(rng.integers(28, 42))}"], [f'"{hexed(rng.integers(28, 42))}"'], [f"AKIA{mixed('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 16)}"], [f"key={mixed('abcdefghijklmnopqrstuvwxyz0123456789', 24)}"], [f"sk_{mixed('abcdefghijklmnopqrstuvwxyz0123456789', 24)}"], [f"secret={hexed(32)}"]],
    }
    cues = {"phone": ["call", "phone:", "tel.", "fax", "at", "number", "mobile", "and"], "card": ["card", "visa", "card:", "paid", "number", "with"], "ip": ["address", "host", "ip", "from", "at"], "email": ["mail", "write", "contact:", "to", "at"], SECRET: ["token", "=", "key", "with", "the", "secret:", "and"]}
    plain = [["in", "1998"], ["on", "12.05.2021"], ["2020-01-31"], ["costs", "19.99"], ["about", "1,250", "people"], ["order", "48213377"], ["version", "2.10.3"], ["at", "10:30"], ["pages", "12-18"], ["room", "204b"], ["1", "2", "3", "4", "5"], ["from", "1914", "to", "1918"], ["id", "7712345678901"], ["4", "x", "100", "m"], ["score", "21-14"], ["isbn", "978-3-16-148410-0"], ["@home"], ["section", "3.2.1.4.5"], ["10", "000", "000"], ["100200300400"], ["tkn.36@"], ["5551234"], ["25", "500", "1000", "2500"], ["total:", "123456789"], ["2021/22"], ["no.", "17"], ["30%"], ["12345678901234567890123"],
             ["mp3"], ["covid19"], ["x86_64"], ["h264", "and", "utf8"], ["sku-12345-ab"], ["img_20200101_123456.jpg"], ["https://example.org/a/12345678"], ["report-v3.pdf"], ["3rd"], ["b2b"], ["4.0."], ["page", "(at)", "top"], ["ipv6"], ["a1b2c3"], ["windows11"], ["section4subsection12"], ["2nd-edition-2019"], ["population", "1234567890"], ["12", "45", "67"], ["year", "2001", "2002", "2003", "2004"], ["see", "[at]", "3"]]
    mark = lambda kind, words: [(w, f"{'B' if i == 0 else 'I'}-{kind}") for i, w in enumerate(words)]
    out: list[list[tuple[str, str]]] = []
    for _ in range(per_pattern):
        for kind, make in values.items():
            for words in make():
                cue = cues[kind][rng.integers(len(cues[kind]))]
                tail = [[], ["and", "more"], ["in", num(4)], ["."]][rng.integers(4)]
                out.append([("please", "O"), (cue, "O"), *mark(kind, words), *((w, "O") for w in tail)])
                # two values side by side
                other = ("phone", "card", "ip", "email")[rng.integers(4)]
                if other != kind:
                    beside = values[other]()
                    out.append([(cue, "O"), *mark(kind, words), *mark(other, beside[rng.integers(len(beside))]), ("now", "O")])
        for words in plain:
            out.append([("the", "O"), *((re.sub("[0-9]", lambda m: num(1), w) if rng.random() < 0.5 else w, "O") for w in words), ("were", "O")])
    return out


def _zones_of(sentence: list[tuple[str, str]]) -> Iterator[tuple[list[tuple[str, str, str]], list[int]]]:
    words, ends = [w for w, _ in sentence], np.cumsum([len(w) + 1 for w, _ in sentence])
    for zone in zones(" ".join(words)):
        first = int(np.searchsorted(ends, zone[0][0], "right"))
        yield [(words[k], b, a) for k, (_, _, b, a) in enumerate(zone, first)], [LABELS.index(sentence[k][1]) for k in range(first, first + len(zone))]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis)
    return m + np.log(np.exp(x - np.expand_dims(m, axis)).sum(axis))


@functools.cache
def trained(rounds: int = 15, rate: float = 0.3, ridge: float = 0.002) -> ShapeField:
    """Maximum likelihood on the labelled table: forward-backward gradients of one zone at a time, with adaptive steps."""
    zones = [z for s in labelled_table() for z in _zones_of(s)]
    names: dict[str, int] = {}
    for zone, _ in zones:
        for i, (w, a, b) in enumerate(zone):
            for f in word_features(w, a, b, i, len(zone)):
                names.setdefault(f, len(names))
    n = len(LABELS)
    first = np.array([_NEVER if x.startswith("I-") else 0.0 for x in LABELS])
    field = ShapeField(names, np.zeros((len(names), n)), _BARRED.copy(), first)
    seen_w, seen_m = np.full_like(field.weights, 1e-6), np.full((n, n), 1e-6)
    data = [(field.ids(z), y) for z, y in zones]
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for k in order.permutation(len(data)):
            ids, y = data[k]
            e, size = field.emissions(ids), len(y)
            fore, aft = np.zeros((size, n)), np.zeros((size, n))
            fore[0] = e[0] + field.start
            for t in range(1, size):
                fore[t] = _logsum(fore[t - 1][:, None] + field.moves, 0) + e[t]
            for t in range(size - 2, -1, -1):
                aft[t] = _logsum(field.moves + (e[t + 1] + aft[t + 1])[None, :], 1)
            z = _logsum(fore[-1], 0)
            node = -np.exp(fore + aft - z)
            node[np.arange(size), y] += 1
            edge = np.zeros((n, n))
            for t in range(1, size):
                edge -= np.exp(fore[t - 1][:, None] + field.moves + (e[t] + aft[t])[None, :] - z)
                edge[y[t - 1], y[t]] += 1
            for f, g in zip(ids, node, strict=True):
                g = g - ridge * field.weights[f]
                seen_w[f] += g * g
                field.weights[f] += rate * g / np.sqrt(seen_w[f])
            seen_m += edge * edge
            field.moves += np.where(_BARRED < 0, 0, rate * edge / np.sqrt(seen_m))
    return field


def zones(text: str) -> Iterator[list[tuple[int, int, str, str]]]:
    """Runs of words with a cue, and of those beside a bracketed "at" or "dot", as (start, end, word before, word after) of each
    word. Words are parted by white space; a run stays on its line."""
    run: list[tuple[int, int]] = []
    end, pos = -1, 0  # of the run; where to look on
    while True:
        beside = _NEXT.match(text, end) if run and _BRACKETED.fullmatch(text, *run[-1]) else None
        if beside:
            a, pos = beside.span(1)
        elif m := _CUES.search(text, pos):
            a = m.start()
            while a > pos and text[a - 1] not in " \t\n\v\f\r":
                a -= 1
            pos = _WORD.match(text, a).end()
        else:
            break
        near = bool(run) and 0 < a - end <= 2 and text[end:a].strip(" \t") == ""
        if _BRACKETED.fullmatch(text, a, pos) and not near:
            b = a - 1 if a > 0 and text[a - 1] in " \t" else a
            c = b
            while c > max(end, 0) and text[c - 1] not in " \t\n\v\f\r":
                c -= 1
            if c < b < a:
                if run and not (0 < c - end <= 2 and text[end:c].strip(" \t") == ""):
                    yield _framed(text, run)
                    run = []
                run.append((c, b))
                near = True
        if run and not near:
            yield _framed(text, run)
            run = []
        run.append((a, pos))
        end = pos
    if run:
        yield _framed(text, run)


def _framed(text: str, run: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    a = run[0][0]
    while a > 0 and text[a - 1] in " \t\n\v\f\r":
        a -= 1
    b = a
    while b > 0 and text[b - 1] not in " \t\n\v\f\r":
        b -= 1
    after = _WORD.search(text, run[-1][1])
    words = [text[b:a], *(text[x:y] for x, y in run), after[0] if after else ""]
    return [(x, y, words[i], words[i + 2]) for i, (x, y) in enumerate(run)]


_EDGE = "()[]<>{}\"',;:.!?"


def added_spans(texts: list[str], bases: list[list[Span]], field: ShapeField) -> list[list[Span]]:
    """What the random field finds beside the base spans."""
    where, seqs = [], []
    for i, text in enumerate(texts):
        for zone in zones(text):
            where.append((i, zone))
            seqs.append([(text[a:b], before, after) for a, b, before, after in zone])
    out: list[list[Span]] = [[] for _ in texts]
    for (i, zone), labels in zip(where, field.decode(seqs), strict=True):
        k = 0
        while k < len(labels):
            if labels[k][0] != "B":
                k += 1
                continue
            j = k + 1
            while j < len(labels) and labels[j] == f"I-{labels[k][2:]}":
                j += 1
            kind, a, b = labels[k][2:], zone[k][0], zone[j - 1][1]
            raw = texts[i][a:b]
            a, b = b - len(raw.lstrip(_EDGE.replace("(", "") if kind == "phone" else _EDGE)), a + len(raw.rstrip(_EDGE))
            if kind == SECRET and a < b:
                a += texts[i][a:b].rstrip("=").rfind("=") + 1
                a += len(texts[i][a:b]) - len(texts[i][a:b].lstrip(_EDGE))
            if a < b and holds(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in bases[i]):
                out[i].append((kind, a, b))
            k = j
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: ((*KINDS, SECRET).index(s[0]), s[1], s[2])))


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, secret_spans string"
#: Texts that are decoded at once.
BATCH = 500


def find(docs: DataFrame, text: str = "text", field: ShapeField | None = None) -> DataFrame:
    """``docs`` with ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base spans), ``base_sha256``, ``spans`` (base and added) and
    ``secret_spans`` added; spans are ``kind:start:end`` in code points, by kind and start. Columns of these names are
    replaced, others are carried and not read.

    Null text counts as empty; a text without cues has no spans. Whole texts are read, however long their words. Of two
    kinds that could hold for a word the random field's best path decides; equally good paths go to the label listed first.
    Each row stands for itself, so repeated rows repeat their result; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or trained())

    def scan(column: pa.Array) -> pa.Array:
        parts: list[list] = [[] for _ in range(len(KINDS) + 3)]
        for lo in range(0, len(column), BATCH):
            texts = [t.as_py() or "" for t in column[lo : lo + BATCH]]
            bases = [base_spans(t) if _CUES.search(t) else [] for t in texts]
            for base, more in zip(bases, added_spans(texts, bases, shared.value), strict=True):
                for out, k in zip(parts, KINDS, strict=False):
                    out.append(sum(s[0] == k for s in base))
                parts[-3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                parts[-2].append(joined(base + [s for s in more if s[0] != SECRET]))
                parts[-1].append(joined([s for s in more if s[0] == SECRET]))
        kinds = [*[pa.int64()] * len(KINDS), pa.string(), pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(parts, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")])

    got = F.arrow_udf(scan, FOUND)(docs[text].cast("string"))
    return docs.withColumns({f.split()[0]: got[f.split()[0]] for f in FOUND.split(", ")})


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the first kind."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``: counts and digest of the base spans, all spans, and secrets. Null and
    empty texts have none. Repeated rows each give their row; an empty table gives an empty result; extra columns are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs).drop("text")
