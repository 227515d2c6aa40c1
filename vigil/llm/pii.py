"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes for what they miss.

The patterns give the base spans of email, ip, card and phone. The field labels tokens (runs of letters, runs of digits,
single other characters) as outside, or as the beginning or inside of one of the four kinds. Its features are shapes:
classes of the token and of its neighbours, the number that a token belongs to (digits in all, Luhn, dotted quad, how it
opens) and the last telling word before ("call", "card" ...). Weights maximise the regularised likelihood of a
small labelled table, which a rule builds from marked sentences in four languages; decoding is Viterbi in numpy over
batches of chains of similar length. Spans that the field adds must have the digits or signs of their kind and may not
touch a base span.

Only words with a digit or an @, spelt-out signs ("at", "dot") beside words, may be labelled at all: all others are outside by definition, so
they cut a text's chain into short ones that are decoded by themselves with the same result.

Null and empty texts have no spans. Repeated rows are read alike, null ids pass. Very long texts are read whole: the base
patterns take time in proportion to the text, chains are padded only to others of their length. Empty tables give no
rows; other columns may have any names and are dropped. Without labelled rows there are base spans only.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import words as wd

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits is entered at its first: none is read twice
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, ordered."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:  # from each @ to both sides, as no address holds two of them
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out)


# Words that tell what a number near them is, and spelt-out signs of addresses.
TELLING = {
    "phone": "phone call tel telephone mobile fax cell ring telefon anrufen handy rufnummer tél téléphone appelez portable teléfono llame móvil",
    "card": "card visa mastercard amex credit debit karte kreditkarte kartennummer carte bancaire tarjeta crédito",
    "ip": "ip host server address login adresse serveur servidor dirección",
    "email": "mail email write contact schreiben écrivez courriel correo escriba",
    "plain": "order invoice version license number no page id article total ref isbn rechnung bestellung nummer commande facture pedido factura número",
}
AT_WORDS, DOT_WORDS = ("at", "arroba", "ät", "arobase"), ("dot", "punkt", "punto", "point")
_TELLING = {w: kind for kind, words in TELLING.items() for w in words.split()}
_SPELT = re.compile(rf"[\[({{<]?(?:{'|'.join(AT_WORDS + DOT_WORDS)})[\])}}>]?", re.IGNORECASE)
_HINTS = [f"{a}{w}{b}" for w in AT_WORDS for a, b in ("()", "[]", "{}", "<>")] + [f" {w} " for w in DOT_WORDS]
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.DOTALL)
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().0-9/-]*[0-9])?")


def _chains(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, telling word's kind) of the runs of words that may be labelled."""
    if not (_DIGIT.search(text) or "@" in text):
        low = text.lower()
        if not any(h in low for h in _HINTS):
            return
    for line in re.finditer("[^\n]+", text):
        words = list(_WORD.finditer(text, line.start(), line.end()))
        spelt = [_SPELT.fullmatch(w[0]) is not None for w in words]
        signs = [s and (w[0][0] in "[({<" or w[0].lower() in DOT_WORDS) for s, w in zip(spelt, words)]
        may = [bool(re.search("[0-9@]", w[0])) for w in words]
        for i in range(len(words)):
            if signs[i]:  # a sign in brackets or a spelt-out dot takes its neighbours in, through a spelt-out at as well
                low, high = i, i
                while low > 0 and low > i - 3:
                    low -= 1
                    if not spelt[low] and not spelt[low + 1]:
                        break
                high = min(i + 1, len(words) - 1)
                may[low : high + 1] = [True] * (high + 1 - low)
        i = 0
        while i < len(words):
            if not may[i]:
                i += 1
                continue
            j = i
            while j + 1 < len(words) and may[j + 1] and text[words[j].end() : words[j + 1].start()] == " ":
                j += 1
            near = [_TELLING.get(w[0].lower().strip(".,:;#()\"'"), "") for w in words[max(0, i - 4) : i]]
            yield words[i].start(), words[j].end(), next((k for k in reversed(near) if k), "none")
            i = j + 1


def _shape(token: str) -> str:
    if token[0].isdigit() and token.isascii():
        n = len(token)
        return f"d{n if n < 5 else 5 if n < 9 else 9 if n < 12 else 12 if n < 15 else 15 if n < 17 else 17}"
    if token[0].isalpha():
        low = token.lower()
        if low in AT_WORDS:
            return "at"
        if low in DOT_WORDS:
            return "dot"
        case = "l" if token.islower() else "U" if token.isupper() else "M"
        return f"{case}{min(len(token), 4)}" if token.isascii() else f"{case}+"
    return token if token in " .-()+@[]{}<>/:_%,;\"'#$€=!?" else "other"


def _bucket(n: int) -> int:
    return next(i for i, top in enumerate((2, 4, 6, 8, 11, 12, 14, 16, 19, 1 << 40)) if n <= top)


def _features(text: str, start: int, end: int, near: str) -> tuple[list[tuple[int, int]], list[list[str]]]:
    """Spans and features of a chain's tokens."""
    spans = [m.span() for m in _TOKEN.finditer(text, start, end)]
    shapes = [_shape(text[a:b]) for a, b in spans]
    about = ["no number"] * len(spans)
    numbers = [m.span() for m in _NUMBER.finditer(text, start, end)]
    i = 0
    for a, b in numbers:
        d = _digits(text[a:b])
        quad = text[a:b].split(".")
        quad = len(quad) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in quad)
        whole = (a == start or text[a - 1] in " \"'(<") and (b == end or text[b] in " .,;:!?\"')>%#$*&|")
        said = f"{_bucket(len(d))} {luhn(d)} {quad} {whole}"
        opens = "+" if text[a] == "+" else "(" if text[a] == "(" else "0" if d[0] == "0" else "n"
        while i < len(spans) and spans[i][0] < a:
            i += 1
        while i < len(spans) and spans[i][1] <= b:
            about[i] = f"{said}|{opens}|{'one' if len(d) == b - a else 'parts'}"
            i += 1
    signs = f"{'@' if '@' in text[start:end] else ''}{'at' if 'at' in shapes else ''}{'dot' if 'dot' in shapes or '.' in shapes else ''}"
    padded = ["start", "start", *shapes, "end", "end"]
    rows = []
    for t in range(len(spans)):
        own, w = about[t], padded[t : t + 5]
        said, opens, parts = own.split("|") if "|" in own else (own, "", "")
        rows.append(
            [f"0 {w[2]}", f"-1 {w[1]}", f"+1 {w[3]}", f"-2 {w[0]}", f"+2 {w[4]}", f"-1 0 {w[1]} {w[2]}", f"0 +1 {w[2]} {w[3]}", f"number {said}"]
            + [f"opens {said} {opens} {parts}", f"near {near} {said}", f"near {near} {w[2]}", f"signs {signs} {w[2]}", f"opens {opens} {near} {parts}"]
        )
    return spans, rows


FEATURES = 13


@dataclass(frozen=True)
class Settings:
    labelled_rows: int = 20_000
    ridge: float = 0.02
    steps: int = 120
    #: Tokens, with padding, in one numpy batch.
    batch: int = 1 << 15


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Field:
    """Weights by feature and label, and of label pairs; O stands before and after each chain."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, pairs: np.ndarray):
        self.names, self.weights, self.pairs = names, weights, pairs

    def ids(self, rows: list[list[str]]) -> np.ndarray:
        return np.array([[self.names.get(f, len(self.names)) for f in row] for row in rows], np.int64).reshape(-1, FEATURES)

    def decode(self, chains: list[np.ndarray], batch: int) -> list[np.ndarray]:
        """The best labels of each chain of feature ids."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted(range(len(chains)), key=lambda i: len(chains[i]))
        while order:
            longest = len(chains[order[-1]])
            take = max(1, min(len(order), batch // max(longest, 1)))
            some, order = order[-take:], order[:-take]
            for i, labels in zip(some, self._viterbi([chains[i] for i in some], longest)):
                out[i] = labels
        return out

    def _viterbi(self, chains: list[np.ndarray], longest: int) -> list[np.ndarray]:
        n, size = len(LABELS), np.array([len(c) for c in chains])
        score = np.full((len(chains), n), -np.inf)
        score[:, 0] = 0
        back = np.zeros((longest, len(chains), n), np.int8)
        for t in range(longest):
            live = size > t
            step = score[live][:, :, None] + self.pairs
            back[t, live] = step.argmax(axis=1)
            score[live] = step.max(axis=1) + self.weights[np.stack([c[t] for c, a in zip(chains, live) if a])].sum(axis=1)
        label = (score + self.pairs[:, 0]).argmax(axis=1)
        out = np.zeros((longest, len(chains)), np.int64)
        for t in range(longest - 1, -1, -1):
            live = size > t
            out[t, live] = label[live]
            label[live] = back[t, live, label[live]]
        return [out[:k, i] for i, k in enumerate(size)]

    def added(self, texts: list[str], base: list[list[tuple[int, int, int]]], batch: int) -> list[list[tuple[int, int, int]]]:
        """The spans that the field adds to the base spans of each text."""
        owner, tokens, chains = [], [], []
        for i, text in enumerate(texts):
            for start, end, near in _chains(text):
                spans, rows = _features(text, start, end, near)
                owner.append(i), tokens.append(spans), chains.append(self.ids(rows))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, spans, labels in zip(owner, tokens, self.decode(chains, batch)):
            out[i] += [x for x in _read(texts[i], spans, labels) if not any(a < x[2] and x[0] < b for a, _, b in base[i])]
        return out


def _allowed() -> np.ndarray:
    """Inside follows only its own beginning or inside."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for j, to in enumerate(LABELS):
        if to[0] == "I":
            out[:, j] = [0 if x[1:] == to[1:] else -np.inf for x in LABELS]
    return out


def _quad(said: str) -> bool:
    parts = re.findall("[0-9]+", said)
    return len(parts) == 4 and all(len(p) < 4 and int(p) < 256 for p in parts) or said.count(":") > 2


#: What a span of each kind must have, whatever its labels.
_NEEDS = (
    lambda said: re.search(rf"\w.*(?:@|[^\w](?:{'|'.join(AT_WORDS)})[^\w]).*\w", said, re.IGNORECASE) is not None,
    lambda said: re.fullmatch(r"[0-9A-Fa-f.,:\[\]()]+", said) is not None and _quad(said),
    lambda said: re.fullmatch(r"[0-9][0-9 ./-]*[0-9]", said) is not None and 12 <= len(_digits(said)) <= 19,
    lambda said: re.fullmatch(r"[+(0-9][0-9 ()./-]*[0-9]", said) is not None and 7 <= len(_digits(said)) <= 15,
)


def _read(text: str, spans: list[tuple[int, int]], labels: Iterable[int]) -> Iterator[tuple[int, int, int]]:
    """Spans of equal kind, where they have what the kind needs."""
    run: list | None = None
    for (a, b), label in [*zip(spans, labels), ((0, 0), 0)]:
        if run and not (label and label % 2 == 0):
            start, kind, end = run
            if _NEEDS[kind](text[start:end]):
                yield start, kind, end
            run = None
        if label % 2:
            run = [a, label // 2, b]
        elif label:
            run[2] = b


# Marked sentences; 9 stands for any digit, 8 for one from 1 to 8, {kind:...} for a
# span, {hex} for 40 random hexadecimal digits.
SENTENCES = """
Please call {phone:(899) 999-9999} before noon
call me at {phone:899-999-9999} or later
Phone: {phone:899.999.9999} (office)
my cell is {phone:899 999 9999} thanks
Tel. {phone:0899 9999999} erreichbar
Telefon {phone:089/9999999} oder Fax {phone:089/9999998}
Handy: {phone:0189 99999999}
Rufnummer {phone:0899-999999} rund um die Uhr
tél : {phone:08 99 99 99 99} le matin
Téléphone {phone:08.99.99.99.99} merci
appelez le {phone:08 99 99 99 99}
teléfono {phone:899 99 99 99} por favor
llame al {phone:899 999 999} hoy
móvil {phone:899-999-999}
reach us on {phone:+89 999 9999999} today
and then the {phone:+8 (899) 999-9999} of that
fax {phone:00899 99999999}
write to {email:anna.meyer (at) example (dot) org} soon
contact {email:j.smith [at] mail8 [dot] net} now
schreiben Sie an {email:info (at) beispiel (punkt) de} bitte
{email:paul {at} firm {dot} com}
mail {email:maria at example dot com} about it
correo {email:luis arroba ejemplo punto es} hoy
écrivez à {email:marie (arobase) exemple (point) fr} vite
mail {email:bob99@localhost} please
that {email:erth.99@mail8.example.com} of the
email: {email:x_y@host-9}
card {card:8999 9999 9999 9999} expires soon
credit card no {card:8999-9999-9999-9999}
visa {card:8999.9999.9999.9999} was declined
Karte {card:8999 999999 99999} gesperrt
Kreditkarte: {card:8999999999999999}
carte bancaire {card:8999 9999 9999 9999} volée
tarjeta {card:8999/9999/9999/9999} perdida
and of the {card:8999999999999999} with that
und der {card:8999999999999999} ist
de la {card:8999999999999999} en el
card number {card:8999999999999}
ip {ip:89.99.89.89} was seen
from host {ip:189.9.9.89} again
server {ip:89,99,89,89} down
login from {ip:fe80:9:9:9999:9999} failed
address {ip:[89].[99].[89].[89]} blocked
and to {ip:89.89.98.8} of it
Licensed under version 8.9 of it
the License, Version 2.0. All
CC BY-NC 4.0. of
on 2089-08-18 at 18:89 we met
from 18.08.2089 to 19.08.2089 only
in 2089 there were 99 of 999 cases
it costs 8,999.99 dollars or 899 euros
order 8999999999 was shipped
invoice no. 8999999999999999 is paid
Rechnung 89999999 vom 8. Mai
facture 8999999999 du 8 mai
pedido 899999999999 de hoy
ISBN 978-8-99-999999-9 in print
page 89 of 899
room 89, floor 8, at 9 o'clock
tion 899999 thth onre
token = "8a9f9c8e9b9d8a9999f9e8d9c9b9a99999f9e9d9"
token = "{hex}" of the
with "{hex}" and "{hex}"
key 9f8e9d9c9b9a99 is set
at 8:89 he came, at 9:89 she left
scores of 8-9 and 89-99 in 8 games
the point is that 9 of 8 were right
we were at the end at last
x8 y9 z99 and a8b9
version 8.9.89 and 8.9.8-rc9 came out
id 8999-9999 in list 8
number 899 999 of them
ratio 89/99 and 8/9 here
""".strip().splitlines()


def labelled_table(spark, fills: int = 5, seed: int = 7) -> DataFrame:
    """(text, spans): each marked sentence some times with other digits, spans as in the result of found()."""
    rng, rows = random.Random(seed), []
    for _ in range(fills):
        for sentence in SENTENCES:
            spans, text, at = [], "", 0
            for m in re.finditer(r"\{(email|ip|card|phone):((?:\{\w+\}|[^{}])*)\}", sentence):
                text += sentence[at : m.start()]
                spans.append(f"{m[1]}:{len(text)}:{len(text) + len(m[2])}")
                text, at = text + m[2], m.end()
            text += sentence[at:]
            text = re.sub("8", lambda _: str(rng.randint(1, 8)), re.sub("9", lambda _: str(rng.randint(0, 9)), text.replace("8", "\0"))).replace("\0", str(rng.randint(1, 8)))
            while "{hex}" in text:
                text = text.replace("{hex}", f"{rng.getrandbits(160):040x}", 1)
            rows.append((text, ",".join(spans)))
    return spark.createDataFrame(rows, "text string, spans string")


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Field | None:
    """The field of greatest regularised likelihood; at most settings.labelled_rows rows, those of the smallest hashes."""
    s = settings
    picked = labelled.select("text", "spans").orderBy(F.xxhash64("text", "spans"), "text", "spans").limit(s.labelled_rows).collect()
    chains, truth = [], []
    for row in picked:
        text = row.text or ""
        marked = [(int(a), KINDS.index(k), int(b)) for k, a, b in (x.split(":") for x in (row.spans or "").split(",") if x)]
        for start, end, near in _chains(text):
            spans, rows = _features(text, start, end, near)
            label = [next((2 * k + (1 if a == x else 2) for x, k, y in marked if x <= a and b <= y), 0) for a, b in spans]
            chains.append(rows), truth.append(label)
    if not chains:
        return None
    names = {f: i for i, f in enumerate(sorted({f for rows in chains for row in rows for f in row}))}
    field = Field(names, np.zeros((len(names) + 1, len(LABELS))), _allowed())
    _maximise(field, [field.ids(rows) for rows in chains], truth, s)
    return field


def _maximise(field: Field, chains: list[np.ndarray], truth: list[list[int]], s: Settings) -> None:
    """Gradient steps with a rate of its own for each weight; expectations come from forward and backward sums."""
    n, longest, count = len(LABELS), max(map(len, chains)), len(chains)
    ids = np.full((count, longest, FEATURES), len(field.names))
    want = np.zeros((count, longest), np.int64)
    live = np.zeros((count, longest), bool)
    for i, (c, y) in enumerate(zip(chains, truth)):
        ids[i, : len(c)], want[i, : len(c)], live[i, : len(c)] = c, y, True
    fixed, last = _allowed(), live.sum(axis=1) - 1
    before = np.concatenate([np.zeros((count, 1), np.int64), want[:, :-1]], axis=1)
    seen = np.zeros((n, n))
    np.add.at(seen, (before[live], want[live]), 1)
    np.add.at(seen, (want[np.arange(count), last], 0), 1)
    at, target = ids[live], np.eye(n)[want[live]]
    order = np.argsort(at.ravel(), kind="stable")
    name, opens = np.unique(at.ravel()[order], return_index=True)
    pace = [np.full(field.weights.shape, 1e-8), np.full((n, n), 1e-8)]
    pairs = np.zeros((n, n))
    for _ in range(s.steps):
        own = field.weights[ids].sum(axis=2)
        step = pairs + fixed
        fore, aft = np.empty((count, longest, n)), np.empty((count, longest, n))
        for t in range(longest):
            fore[:, t] = (step[0] if t == 0 else _log_sum(fore[:, t - 1][:, :, None] + step, 1)) + own[:, t]
        for t in range(longest - 1, -1, -1):
            ends = (last == t)[:, None]
            after = _log_sum(step + (own[:, t + 1] + aft[:, t + 1])[:, None, :], 2) if t + 1 < longest else step[:, 0]
            aft[:, t] = np.where(ends, step[:, 0], after)
        total = _log_sum(fore[np.arange(count), last] + step[:, 0], 1)
        expected = np.exp(fore + aft - total[:, None, None])[live]
        slope = np.zeros_like(field.weights)
        slope[name] = np.add.reduceat((target - expected)[order // FEATURES], opens)
        both = fore[:, :-1, :, None] + step + (own + aft)[:, 1:, None, :] - total[:, None, None, None]
        found = np.where(live[:, 1:, None, None], np.exp(both), 0).sum(axis=(0, 1))
        found[0] += np.exp(step[0] + own[:, 0] + aft[:, 0] - total[:, None]).sum(axis=0)
        found[:, 0] += np.exp(fore[np.arange(count), last] + step[:, 0] - total[:, None]).sum(axis=0)
        for value, grad, rate in zip((field.weights, pairs), (slope - s.ridge * field.weights, seen - found - s.ridge * pairs), pace):
            rate += grad**2
            value += 0.5 * grad / np.sqrt(rate)
    field.weights[-1] = 0
    field.pairs = pairs + fixed


def found(docs: DataFrame, field: Field | None, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base spans by kind, their digest, and all spans as kind:start:end in code points."""
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[doc_id].dataType.simpleString()

    def said(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def rows(batches):
        field = sent.value
        for batch in batches:
            for part in wd.slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                more = field.added(texts, base, settings.batch) if field else [[] for _ in texts]
                counts = np.array([[sum(k == i for _, k, _ in b) for i in range(4)] for b in base], np.int64).reshape(-1, 4)
                sha = [hashlib.sha256(said(b).encode()).hexdigest() for b in base]
                whole = [said(b + m) for b, m in zip(base, more)]
                columns = [part.column("doc_id"), *(pa.array(counts[:, i]) for i in range(4)), pa.array(sha, pa.string()), pa.array(whole, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    view = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return view.mapInArrow(rows, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
