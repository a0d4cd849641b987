"""Personal data by pattern and by a linear-chain conditional random field over word shapes.

Base spans come from fixed patterns for e-mail addresses, IP addresses, card numbers and phone numbers. The
field labels every white-space separated word of a text with begin/inside tags of the same kinds and of names, postal addresses,
national identity numbers and secrets; its features are shapes of the word and its neighbours, and which of a few
cue words (titles, kinds of streets, names of secrets) they are. It is trained from a small labelled table (by
default one that sample_table() makes from templates, the same each time). A text is one sequence, decoded by Viterbi for all texts of a batch at once.
Scores of shapes are kept, so a word costs a look-up. Where every stretch of other tags around a word would score less than
outside tags, by a bound on what transitions can add, the outside tag is on a best path for certain; only what lies between such words needs
the recursion, with the tags next to it given. Found
spans that overlap no base span are added, if card numbers pass Luhn's rule, IP addresses have parts of at most 255, and postal
addresses have a number.

Defined cases: a null text is empty; a text without words has no spans; offsets are code points,
ends exclusive; where paths tie, outside tags win next to settled words and the label that comes first elsewhere; repeated rows give equal results; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailframe.llm import crf

KINDS = ("email", "ip", "card", "phone")
MORE = ("name", "address", "national_id", "secret")
ALL = (*KINDS, *MORE)
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")
#: Cue words, by kind of cue; a feature is the kind, never the word.
CUES = {
    **dict.fromkeys("mr mrs ms miss dr prof sir herr frau señor señora sr sra monsieur madame mme".split(), "title"),
    **dict.fromkeys("street st road rd avenue ave lane ln drive boulevard blvd way square platz weg gasse allee".split(), "street"),
    **dict.fromkeys("calle avenida rue plaza".split(), "calle"),
    **dict.fromkeys("token key secret password passwd pwd apikey api_key secret_key access_key access_token auth_token bearer credential".split(), "secret"),
    **dict.fromkeys("ssn social nif dni nie passport".split(), "id"),
}
#: The same matches as IP: only the first digit of a run of digits can begin one, so long runs take linear time.
_IP_LINEAR = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DIM = 1 << 14
_EDGE = ".,;:!?\"'<>[]{}#*&%$~|`^="


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """The same matches as EMAIL from left to right, found from each @ instead of from every letter."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; a match that fails its check is dropped, without retries."""
    out = [("email", a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP_LINEAR.finditer(text) if all(_octet(x) for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


_CLASSES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "x" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "X" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})


def shape(word: str) -> str:
    """Letters as x and X, digits as d, with the lengths of digit runs; other signs stay; long runs of one class are cut short."""
    if word.isalpha() and word.islower():
        return "x" if len(word) == 1 else "xx"
    s = word[:64].translate(_CLASSES)
    if not s.isascii():
        s = "".join(c if c.isascii() else "x" if c.islower() else "X" if c.isupper() else "u" for c in s)
    return _REPEAT.sub(r"\1\1", s)


_REPEAT, _SIGN, _HEX = re.compile(r"([xXu])\1{2,}"), re.compile("[=:]"), re.compile("[0-9a-f]+|[0-9A-F]+")
_LONG = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
_STRASSE = re.compile(r".+stra(ß|ss)e$")


def _mixed(word: str) -> str:
    """How the first long run of letters and digits is mixed."""
    if len(word) < 16 or not (m := _LONG.search(word[:256])):
        return ""
    run = m[0]
    digits, lower, upper = (sum(c.isdigit() for c in run), sum(c.islower() for c in run), sum(c.isupper() for c in run))
    return f"{min(len(run), 40) // 8}{'d' * (digits > 2)}{'x' * (lower > 2)}{'X' * (upper > 2)}{'h' * bool(_HEX.fullmatch(run))}"


def _kind_of_word(word: str) -> str:
    """All that features see of a word: its shape, cue, length in steps, and how a long run of letters and digits in it is mixed."""
    core = word.strip(_EDGE).lower()
    cue = CUES.get(core, "")
    if not cue:
        if "=" in core or ":" in core:
            cue = CUES.get(_SIGN.split(core)[0], "") + "="
        elif "stra" in core and _STRASSE.match(core):
            cue = "strasse"
    return f"{shape(word)} {cue} {min(len(word), 40) // 4} {_mixed(word)}"


def _hashed(names: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % _DIM for x in names]


def _features(kind: str) -> tuple[list[int], list[int], list[int]]:
    """Features of a word's own tag, of the tag of the word after it, and of the one before it."""
    s, cue, size, mixed = kind.rsplit(" ", 3)
    digits = s.count("d")
    coarse = re.sub(r"(.)\1+", r"\1", s)
    signs = "".join(c for c in "@+.-()" if c in s)
    own = [f"s{s[:24]}", f"c{coarse[:16]}", f"n{min(digits, 20)}", f"g{signs}", f"p{s[:2]}", f"e{s[-2:]}", f"ng{min(digits, 20)}{signs}", f"q{cue}", f"z{size}", f"m{mixed}", f"mp{mixed}{s[:2]}"]
    return _hashed(own), _hashed([f"l{coarse[:6]}", f"lq{cue}"]), _hashed([f"r{coarse[:6]}", f"rq{cue}"])


def sample_table(n: int = 60, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """A small labelled table of (words, tags) made from templates; tags are O, B-kind, I-kind."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    pick = lambda signs, k: "".join(rng.choice(signs) for _ in range(k))
    name = lambda: rng.choice(["", "é", "ñ"][: 1 + (rng.random() < 0.1) * 2]) + pick("abcdefghiklmnorstu", rng.randint(1, 9))
    big = lambda: name().capitalize()
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    quoted = lambda x: rng.choice([x, f'"{x}"', f"'{x}'", f"{x},", f'"{x}";', f'"{x}"{rng.choice(["###", ".", "%%%", "&&&"])}'])
    end = lambda x: x + rng.choice(["", "", "", ",", ".", ";", ")", "%%%", "***", "###"])
    secret = lambda: rng.choice([pick("0123456789abcdef", rng.choice([32, 40, 40, 64])), f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}", f"sk-{pick(alnum, rng.randint(24, 48))}", f"ghp_{pick(alnum, 36)}", f"xoxb-{num(11)}-{pick(alnum, 24)}", pick(alnum, rng.randint(24, 44))])
    label = lambda: rng.choice(["token", "key", "secret", "password", "api_key", "secret_key", "access_token"])
    title = lambda: rng.choice(["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Señor", "Señora", "Mme"])
    street = lambda: rng.choice(["Street", "St.", "Road", "Rd.", "Avenue", "Ave.", "Lane", "Drive", "Boulevard", "Way"])
    tagged = lambda kind, words: [(w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(words)]
    out = lambda *words: [(w, "O") for w in words]
    makers = {
        "email": [lambda: tagged("email", [end(f"{name()}.{name()}@{name()}.com")]), lambda: tagged("email", [end(f"{name()}{num(2)}@{name()}.org")])],
        "ip": [lambda: tagged("ip", [end(f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}")])],
        "card": [lambda: tagged("card", [num(4), num(4), num(4), end(num(4))]), lambda: tagged("card", [end(f"{num(4)}-{num(4)}-{num(4)}-{num(4)}")]), lambda: tagged("card", [end(num(16))])],
        "phone": [lambda: tagged("phone", [f"({num(3)})", end(f"{num(3)}-{num(4)}")]), lambda: tagged("phone", [end(f"{num(3)}-{num(3)}-{num(4)}")]), lambda: tagged("phone", [f"+{num(rng.randint(1, 2))}", num(3), end(num(7))]), lambda: tagged("phone", [f"+{num(1)}", f"({num(3)})", end(f"{num(3)}-{num(4)}")]), lambda: tagged("phone", [end(f"{num(3)}.{num(3)}.{num(4)}")])],
        "name": [lambda: out(title()) + tagged("name", [big(), end(big())]), lambda: out(title()) + tagged("name", [end(big())])],
        "address": [lambda: tagged("address", [num(rng.randint(1, 4)), big(), end(street())]), lambda: tagged("address", [num(rng.randint(1, 4)), big(), big(), end(street())]), lambda: tagged("address", [f"{big()}straße", end(num(rng.randint(1, 3)))]), lambda: tagged("address", [rng.choice(["Calle", "Rue", "Avenida"]), big(), end(num(rng.randint(1, 3)))])],
        "national_id": [lambda: tagged("national_id", [end(f"{num(3)}-{num(2)}-{num(4)}")]), lambda: out("SSN:") + tagged("national_id", [end(f"{num(3)}-{num(2)}-{num(4)}")]), lambda: out("DNI") + tagged("national_id", [end(f"{num(8)}{pick('ABCDEFGHJKLMNPQRSTVWXYZ', 1)}")])],
        "secret": [lambda: out(label(), rng.choice(["=", ":", "is"])) + tagged("secret", [quoted(secret())]), lambda: out(f"{label()}:") + tagged("secret", [quoted(secret())]), *[lambda: tagged("secret", [f"{label()}{rng.choice('=:')}{quoted(secret())}"])] * 3, lambda: tagged("secret", [end(f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 16)}")]), lambda: tagged("secret", [end(f"sk-{pick(alnum, rng.randint(24, 48))}")])],
    }
    plain = [lambda: out(end(num(rng.randint(1, 12)))), lambda: out(f"{num(2)}.{num(2)}.{num(4)}"), lambda: out(end(f"{num(1)}.{num(2)}")), lambda: out(end(f"{num(4)}-{num(2)}-{num(2)}")), lambda: out(f"{name()}{num(2)}"), lambda: out(f"v{num(1)}.{num(1)}"), lambda: out("@"), lambda: out(f"@{name()}"), lambda: out(f"{num(2)}%"), lambda: out(f"{name().upper()}{num(6)}{name().upper()}"), lambda: out(num(3), num(3)), lambda: out(f"{num(1)},{num(3)}"),
             lambda: out(end(big()), end(big())), lambda: out(big(), name(), end(big())), lambda: out(end(name().upper())), lambda: out(f"{name()}-{name()}"), lambda: out(rng.choice(["***", "$$$", "%%%", "###", "=", "-", "--", "|", "=>", "{", "}", "//", "&&&"])), lambda: out(f"{name()}{rng.choice(['***', '$$$', '%%%', '###', '!!!'])}"), lambda: out(f"https://{name()}.com/{name()}/{name()}-{num(4)}"), lambda: out(f"{name()}_{name()}({name()})"), lambda: out(f"({num(4)})"), lambda: out(label(), name()), lambda: out(rng.choice(["way", "street", "road", "lane", "drive", "key", "secret", "Way", "Key"]), name()),
             lambda: out(title().lower(), name()), lambda: out(f"{num(2)}:{num(2)}:{num(2)}"), lambda: out("-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))), lambda: out(name() + name() + name() + name()), lambda: out(num(rng.randint(1, 4)), name(), name()), lambda: out(num(rng.randint(1, 4)), big(), name()),
             lambda: out(*[big()] * rng.randint(3, 40)), lambda: out(*[f"{big()}."] * rng.randint(3, 40)), lambda: out(*(f"{big()}{rng.choice(['', '.', ','])}" for _ in range(rng.randint(3, 12)))), lambda: out(*[big(), f"{big()}."] * rng.randint(2, 6)), lambda: out(*[name()] * rng.randint(3, 9)), lambda: out(*[end(num(rng.randint(1, 4)))] * rng.randint(2, 3), big(), f"{big()}.")]
    table = []
    for i in range(n):
        for kind in (*ALL, *[None] * 12):
            row = out(*(end(name()) if rng.random() < 0.8 else big() for _ in range(rng.randint(1, 4))))
            row += rng.choice(makers[kind] if kind else plain)()
            if i % 4 == 0:
                row += rng.choice(plain)()
            row += out(*(end(name()) for _ in range(rng.randint(0, 3))))
            table.append(([w for w, _ in row], [t for _, t in row]))
    return table


def _sides(kinds: list[str]) -> list[list[int]]:
    """Features of the tags of a sequence of words, with what their neighbours add."""
    made = [_features(k) for k in kinds]
    edge = _hashed(["l", "lq"]), _hashed(["r", "rq"])
    return [f[0] + (made[i - 1][1] if i else edge[0]) + (made[i + 1][2] if i + 1 < len(made) else edge[1]) for i, f in enumerate(made)]


def fit(table: list[tuple[list[str], list[str]]]) -> crf.Model:
    """Train the field on the labelled table."""
    labels = ["O", *(f"{p}-{k}" for k in ALL for p in "BI")]
    ids = [f for ws, _ in table for f in _sides([_kind_of_word(w) for w in ws])]
    token_offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    offsets = np.concatenate([[0], np.cumsum([len(ws) for ws, _ in table])])
    tags = np.array([labels.index(t) for _, ts in table for t in ts])
    return crf.train(np.array([x for f in ids for x in f]), token_offsets, tags, offsets, labels, _DIM, epochs=12)


class Tagger:
    """The trained field; finds further spans in a batch of texts."""

    def __init__(self, model: crf.Model):
        self.model = model
        self._kinds: dict[str, int] = {}
        self._words: dict[str, int] = {}
        t, start = model.transitions, model.start
        # what a stretch of other tags can gain over outside tags by transitions: for each word, and once for its two ends
        self.inside = (t[1:, 1:] - t[0, 0]).max()
        self.ends = max((t[0, 1:] - t[0, 0]).max(), (start[1:] - start[0]).max()) + max((t[1:, 0] - t[0, 0]).max(), 0.0) - self.inside
        self._scores = np.zeros((64, 3, len(model.labels)), np.float32)
        self._most = np.zeros((64, 3))  # what any other tag gains over the outside tag at most, by the word and by those beside it
        self._kind("")  # number 0: beyond a text's ends

    def _kind(self, kind: str) -> int:
        at = self._kinds.get(kind)
        if at is None:
            at = self._kinds[kind] = len(self._kinds)
            if at == len(self._scores):
                self._scores, self._most = (np.concatenate([x, np.zeros_like(x)]) for x in (self._scores, self._most))
            if kind:
                self._scores[at] = [self.model.weights[f].sum(0) for f in _features(kind)]
            else:
                self._scores[at, 1:] = [self.model.weights[f].sum(0) for f in (_hashed(["l", "lq"]), _hashed(["r", "rq"]))]
            self._most[at] = (self._scores[at, :, 1:].astype(np.float64) - self._scores[at, :, :1]).max(1)
        return at

    def _numbers(self, words: list[str]) -> list[int]:
        known = self._words
        get = known.get
        numbers = [get(w, -1) for w in words]
        if -1 in numbers:
            if len(known) > 500_000 or len(self._kinds) > 100_000:
                self.__init__(self.model)
                known = self._words
                numbers = [-1] * len(words)
            for w in {w for w, n in zip(words, numbers, strict=True) if n < 0}:
                known[w] = self._kind(_kind_of_word(w))
            numbers = [known[w] for w in words]
        return numbers

    def _open(self, gain: np.ndarray) -> np.ndarray:
        """Places that some stretch of other tags might hold: the sum of the gains of a stretch around them, with its ends, is above 0.

        Everywhere else all such stretches lose, so outside tags there are on a best path.
        """
        total = np.concatenate([[0.0], np.cumsum(gain)])
        lowest = np.minimum.accumulate(total)[:-1]  # of the sums up to a start at or before each place
        highest = np.maximum.accumulate(total[:0:-1])[::-1]  # of the sums up to an end at or after it
        return np.flatnonzero(highest - lowest + self.ends > -1e-6)

    def tags(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The label of every word of all texts on a best path of each text, and offsets of the texts."""
        each = [t.split() for t in texts]
        flat = [w for ws in each for w in ws]
        lengths = np.array([len(ws) for ws in each], np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        labels = np.zeros(len(flat), np.int8)
        if not flat:
            return labels, offsets
        number = np.array(self._numbers(flat), np.int64)
        first = np.zeros(len(flat), bool)
        first[offsets[:-1][lengths > 0]] = True
        last = np.append(first[1:], True)
        before, after = np.where(first, 0, np.roll(number, 1)), np.where(last, 0, np.roll(number, -1))
        # words are settled by these bounds already, or else by what their scores say
        gain = self._most[number, 0] + self._most[before, 1] + self._most[after, 2] + self.inside
        open_ = self._open(gain)
        scores = (self._scores[number[open_], 0] + self._scores[before[open_], 1] + self._scores[after[open_], 2]).astype(np.float64)
        gain[open_] = (scores[:, 1:] - scores[:, :1]).max(1) + self.inside
        still = np.isin(open_, self._open(gain), assume_unique=True)
        open_, scores = open_[still], scores[still]
        if len(open_):
            run = np.flatnonzero(np.concatenate([[True], (np.diff(open_) > 1) | first[open_[1:]]]))
            end = np.append(run[1:], len(open_)) - 1
            scores[run] += np.where(first[open_[run]][:, None], self.model.start, self.model.transitions[0])
            scores[end] += np.where(last[open_[end]][:, None], 0.0, self.model.transitions[:, 0])
            free = crf.Model(self.model.labels, self.model.weights, self.model.transitions, np.zeros(len(self.model.labels)))
            labels[open_] = crf.viterbi(free, scores, np.append(run, len(open_)))
        return labels, offsets

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        tags, offsets = self.tags(texts)
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        for i in np.unique(np.searchsorted(offsets, np.flatnonzero(tags), side="right") - 1).tolist():
            now = None
            for tag, m in zip(tags[offsets[i] : offsets[i + 1]].tolist(), _WORD.finditer(texts[i]), strict=True):
                label = self.model.labels[tag]
                kind = label[2:]
                if label[0] == "I" and now and now[0] == kind:
                    now = (kind, now[1], m.end())
                    out[i][-1] = now
                elif tag:
                    now = (kind, *m.span())
                    out[i].append(now)
                else:
                    now = None
        return out



#: Added spans of these kinds pass the check that base spans pass.
_CHECKS = {
    "card": lambda x: 13 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and luhn(d),
    "address": lambda x: any(c.isdigit() for c in x),
    "ip": lambda x: len(p := re.findall("[0-9]+", x)) == 4 and all(map(_octet, p)),
}
_ASSIGNED = re.compile(r"[A-Za-z_]+[=:](?=.)")


def find(texts: list[str | None], tagger: Tagger) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text its base spans, and all spans: base ones and what the field adds."""
    texts = [t or "" for t in texts]
    out = []
    for text, extra in zip(texts, tagger.spans(texts), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for kind, a, b in extra:
            if kind == "secret" and (m := _ASSIGNED.match(text, a, b)):
                a = m.end()
            while a < b and text[a] in _EDGE:
                a += 1
            while b > a and text[b - 1] in _EDGE:
                b -= 1
            if kind in _CHECKS and not _CHECKS[kind](text[a:b]):
                continue
            if a < b and not any(x < b and a < y for x, y in taken):
                added.append((kind, a, b))
        everything = sorted(base + added, key=lambda s: (ALL.index(s[0]), s[1]))
        out.append((base, everything))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_name long, n_address long, n_national_id long, n_secret long"


def detect(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """docs (doc_id, text) to COLUMNS; counts and digest are of the base spans, spans has all."""
    model = fit(sample_table() if table is None else table)

    def run(batches: Iterator[pa.RecordBatch]):
        tagger = Tagger(model)
        schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), *((f"n_{k}", pa.int64()) for k in MORE)])
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                rows = []
                for d, (base, spans) in zip(part["doc_id"].to_pylist(), find(part["text"].to_pylist(), tagger), strict=True):
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append((d, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), *(sum(s[0] == k for s in spans) for k in MORE)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)
