"""Personal data by weak supervision.

Exact patterns (e-mail, IP address, card, phone) always count. Further candidates are
broad: tokens of letters and digits, values after a name, digit runs, spelled-out e-mails,
capitalised pairs and names after titles. Seven labelers vote on each, for it, against it
or not at all: its shape, word lists, the words before it and behind it, statistics of its
characters, known formats, and its place. Votes are counted over the whole corpus by
kind and pattern of votes; expectation-maximisation estimates for each kind how far each
labeler can be relied on, and a logistic classifier of the candidate's own traits is
trained on the resulting probabilities. It decides which candidates become spans; of
accepted ones that overlap, the likeliest stays.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivane.llm.common import written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "name")
THRESHOLD = 0.5
#: Share of the candidates that is taken to be personal before EM; generators are broad.
PRIOR = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_PAIR = re.compile(r"""(?<![A-Za-z0-9])([A-Za-z][A-Za-z_-]{2,19})[ ]?[=:][ ]?["']?([A-Za-z0-9_+/=-]{8,}+)""")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+|xox[bap]-[A-Za-z0-9-]{10,}+)(?![A-Za-z0-9])")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_BARE_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])")
_DIGITS = re.compile(r"(?<![0-9A-Za-z+.,_/-])\(?[0-9]++(?:[ ./()-]{1,2}[0-9]++)*+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9.])[A-Za-z0-9._-]{2,40}[ ]?[\[(]?(?:at|@)[\])]?[ ]?[A-Za-z0-9-]{2,40}[ ]?[\[(]?dot[\])]?[ ]?(?:com|org|net|edu|de|fr|es)(?![A-Za-z])")
_TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.?[ ]([A-Z][a-z]{1,20}(?:[ ][A-Z][a-z]{1,20})?)")
_CAPITALISED = re.compile(r"(?<![\w.-])[A-Z][a-z]{1,20}[ ][A-Z][a-z]{1,20}(?![\w-])")
#: Generators, as bits of a candidate's ``pattern``.
PAIR, KEY, TOKEN, GROUPED, DIGITS, SPELLED, TITLED, CAPITALISED = (1 << i for i in range(8))
#: Word lists of the labelers.
SECRET_WORDS = frozenset("token password passwd pwd secret apikey api_key api-key access_key auth bearer credential key".split())
FIRST_NAMES = frozenset("james mary john robert michael william david richard joseph thomas anna maria peter hans klaus jean pierre marie sophie carlos jose luis carmen ana juan".split())
PHONE_WORDS = frozenset("call phone tel telephone mobile fax contact reach dial cell whatsapp telefon handy téléphone appelez teléfono llame".split())
CARD_WORDS = frozenset("card visa mastercard amex credit debit karte carte tarjeta".split())
MAIL_WORDS = frozenset("mail email e-mail write contact reach courriel correo".split())
NAME_WORDS = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora name named dear patient customer signed contact".split())
CUES = {"secret": SECRET_WORDS, "phone": PHONE_WORDS, "card": CARD_WORDS, "email": MAIL_WORDS, "name": NAME_WORDS}
AGAINST = frozenset("version license isbn issn page pages chapter figure table section copyright commit sha checksum id uuid order invoice serial article row line item build release doi url http https year".split())
UNITS = frozenset("percent kg km cm mm usd eur dollars euros items pages years people bytes mb gb ms units".split())
PLACES = frozenset("license public general version foundation terms rights street st avenue road university college institute city county river lake bank museum hotel inc ltd llc corp gmbh company monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december".split())
VERBS = frozenset("look looking meet meeting stay staying arrive arrived is are was be being the a see live lives work works only not start started".split())
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:19|20)[0-9]{2}")
_ISSUER = re.compile(r"4|5[1-5]|3[47]|6011|65")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ so that the time is linear in the text."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, m.end()))
        done = m.end() if m else done
        at = text.find("@", max(at + 1, done))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    small = lambda p: len(p := p.lstrip("0")) < 4 and int(p or 0) <= 255
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact patterns' spans, by kind as listed, then start."""
    digits = re.search("[0-9]", text) is not None
    found = {"email": emails(text) if "@" in text else [], "ip": ips(text) if digits else [], "card": cards(text) if digits else [], "phone": phones(text) if digits and "+" in text else []}
    return [(k, a, b) for k in BASE_KINDS for a, b in found[k]]


def candidates(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, generators) of spans that the exact patterns may have missed, by place."""
    found: dict[tuple[str, int, int], int] = {}

    def add(kind: str, span: tuple[int, int], by: int) -> None:
        found[kind, *span] = found.get((kind, *span), 0) | by

    if "=" in text or ":" in text:
        for m in _PAIR.finditer(text):
            if not text.startswith("//", m.start(2)):
                add("secret", m.span(2), PAIR)
    if "AKIA" in text or "ghp_" in text or "sk-" in text or "xox" in text:
        for m in _KEY.finditer(text):
            add("secret", m.span(), KEY)
    if re.search("[0-9]", text):
        for m in _TOKEN.finditer(text):
            if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
                add("secret", m.span(), TOKEN)
        for m in _BARE_PHONE.finditer(text):
            add("phone", m.span(), GROUPED)
        for m in _DIGITS.finditer(text):
            # Checked here: a look-ahead would begin long runs again and again.
            n = 0 if text[m.end() : m.end() + 1].isalnum() else sum(c.isdigit() for c in m[0])
            if 7 <= n <= 12:
                add("phone", m.span(), DIGITS)
            elif 13 <= n <= 19:
                add("card", m.span(), DIGITS)
    if "dot" in text:
        for m in _SPELLED.finditer(text):
            add("email", m.span(), SPELLED)
    if any(x in text for x in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor")):
        for m in _TITLED.finditer(text):
            add("name", m.span(1), TITLED)
    for m in _CAPITALISED.finditer(text):
        add("name", m.span(), CAPITALISED)
    return [(*k, by) for k, by in sorted(found.items(), key=lambda x: (x[0][1], -x[0][2], KINDS.index(x[0][0])))]


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _words_before(text: str, at: int) -> list[str]:
    return re.findall(r"[^\W\d][\w-]*", text[max(0, at - 40) : at].lower())[-4:]


def _word_behind(text: str, at: int) -> str:
    m = re.match(r"[ ]?([^\W\d][\w-]*|%)", text[at : at + 30].lower())
    return m[1] if m else ""


def _groups(value: str) -> list[int]:
    return [len(x) for x in re.findall("[0-9]+", value)]


def _vote(yes: bool, no: bool = False) -> int:
    return 1 if yes else -1 if no else 0


def votes(text: str, kind: str, a: int, b: int, pattern: int) -> tuple[int, ...]:
    """One vote a labeler: 1 personal, -1 not, 0 none.

    A labeler of words around a span or of its place says yes or no each time: one that
    only ever says no, or only yes, has nothing for EM to learn from.
    """
    value, before, behind = text[a:b], _words_before(text, a), _word_behind(text, b)
    cues, last = CUES[kind], before[-1] if before else ""
    alpha, digit = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    cue_before = _vote(any(w in cues for w in before) and last not in AGAINST, True)
    if kind == "secret":
        # An issuer's own format speaks for itself: the words around it only add to that.
        entropy, known = _entropy(value), bool(pattern & KEY)
        inside = text[a - 1 : a] in ("/", "#", "?", "&") or (text[b : b + 1] in ("/", ".", "@") and text[b + 1 : b + 2].isalnum())
        return (
            _vote(alpha and digit, True),
            _vote(known or last in SECRET_WORDS, last in AGAINST or last in PHONE_WORDS or last in CARD_WORDS),
            0 if known and cue_before < 0 else cue_before,
            _vote(not inside, True),
            _vote(entropy >= 3.0 and len(value) >= 16, entropy < 2.5 or value.isalpha()),
            _vote(known or (len(value) in (32, 40, 64) and re.fullmatch("[0-9a-f]+", value) is not None), _UUID.fullmatch(value) is not None or _DATE.fullmatch(value) is not None or value.count("-") + value.count("/") + value.count("_") > 3),
            _vote(text[a - 1 : a] in ("'", '"', "=") or text[max(0, a - 2) : a] == ": ", not known),
        )
    groups, digits = _groups(value), _digits(value)
    ends = b == len(text) or text[b] in "\n,;!?)" or text[b : b + 2] in (". ", ".\n", ".")
    if kind == "phone":
        return (
            _vote((groups == [3, 3, 4] or len(groups) in (3, 4, 5) and max(groups) <= 4) and not _DATE.fullmatch(value), len(groups) == 1),
            _vote(last in PHONE_WORDS, last in AGAINST or last in SECRET_WORDS),
            cue_before,
            _vote(behind not in UNITS and behind != "%", True),
            _vote(len(set(digits)) >= 5, len(set(digits)) <= 3),
            _vote("(" in value or groups == [3, 3, 4], _DATE.fullmatch(value) is not None or "/" in value or digits.startswith(("978", "979"))),
            _vote(ends, True),
        )
    if kind == "card":
        return (
            _vote(groups in ([4, 4, 4, 4], [4, 6, 5]), True),
            _vote(_ISSUER.match(digits) is not None, True),
            cue_before,
            _vote(behind in ("exp", "expires", "cvv", "valid"), behind in UNITS),
            _vote(False, len(set(digits)) <= 3),
            _vote(len(digits) in (15, 16), True),
            _vote(False, not luhn(digits)),
        )
    if kind == "email":
        local = re.split(r"[ \[(@]", value.lower(), maxsplit=1)[0]
        return (
            _vote("[" in value or "(" in value, local in VERBS),
            _vote(re.search(r"(?:com|org|net|edu)$", value) is not None),
            cue_before,
            _vote(False, behind in PLACES),
            _vote(any(c in "._-0123456789" for c in local), local.isalpha()),
            _vote(re.search(r"dot[\])]?[ ]?[a-z]+$", value) is not None),
            _vote(ends, True),
        )
    first, second = (value.lower().split() + [""])[:2]
    # Headings and junk: a run of capitalised words, or one word again.
    chained = first == second or re.search(r"(?:^|[^\w])[A-Z][\w]*[ ]$", text[max(0, a - 24) : a]) is not None and not pattern & TITLED or re.match(r"[ ][A-Z]", text[b : b + 2]) is not None
    starts = a == 0 or text[a - 1] == "\n" or text[max(0, a - 2) : a] in (". ", "! ", "? ", ": ")
    return (
        _vote(bool(second) and not chained, chained),
        _vote(first in FIRST_NAMES and not chained, chained or first in PLACES or second in PLACES or first in AGAINST or second in AGAINST),
        cue_before,
        _vote(behind in ("said", "wrote", "says", "asked", "told"), behind in PLACES),
        _vote(False, len(first) < 3 or first == second),
        _vote(bool(pattern & TITLED), True),
        _vote(not starts and not chained, True),
    )


LABELERS = 7
#: Labelers of which one must say yes: word lists, words before, known formats.
EVIDENCE = [1, 2, 5]


def traits(text: str, kind: str, a: int, b: int, pattern: int) -> int:
    """Binary traits of a candidate, as bits: what the classifier sees."""
    value, before = text[a:b], _words_before(text, a)
    entropy = _entropy(value)
    tests = (
        bool(pattern & (KEY | GROUPED | TITLED)),
        bool(pattern & PAIR),
        len(value) >= 12,
        len(value) >= 16,
        len(value) >= 32,
        any(c.isdigit() for c in value),
        any(c.isalpha() for c in value),
        any(c.isupper() for c in value),
        any(c in " .-()/_" for c in value),
        bool(before) and before[-1] in CUES[kind],
        any(w in CUES[kind] for w in before),
        any(w in AGAINST for w in before),
        entropy >= 3.0,
        entropy >= 3.7,
        text[a - 1 : a] in ("'", '"', "=", ":"),
        text[a - 1 : a] in ("/", "#", "?", "&") or text[b : b + 1] in ("/", "@", "%"),
        _DATE.fullmatch(value) is not None or _UUID.fullmatch(value) is not None or len(re.findall("[-/_]", value)) > 2,
        _groups(value) == [3, 3, 4] or "(" in value or "[" in value,
        kind == "name" and value.split()[0].lower() in FIRST_NAMES,
        kind == "name" and any(w in PLACES for w in value.lower().split()),
        kind == "name" and (len({*value.split()}) < len(value.split()) or re.match(r"[ ][A-Z]", text[b : b + 2]) is not None or text[max(0, a - 2) : a - 1].isalpha() and text[max(0, a - 24) : a].split()[-1:] != [] and text[max(0, a - 24) : a].split()[-1][0].isupper()),
        kind in ("name", "email") and (a == 0 or text[max(0, a - 2) : a] in (". ", "! ", "? ", ": ")),
    )
    return sum(1 << i for i, x in enumerate(tests) if x)


TRAITS = 22
FOUND = "doc_id {kind}, base array<struct<kind:string,start:long,end:long>>, more array<struct<kind:string,start:long,end:long,votes:int,traits:int>>"


def _covered(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
    for batch in batches:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            mine = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in mine])
            starts, ends = _covered(mine)
            rows = []
            for kind, a, b, pattern in candidates(text) if len(text) > 7 else []:
                before = bisect.bisect_left(starts, b) - 1
                if before >= 0 and ends[before] > a:
                    continue
                code = 0
                for v in votes(text, kind, a, b, pattern):
                    code = code * 3 + v + 1
                rows.append({"kind": kind, "start": a, "end": b, "votes": code, "traits": traits(text, kind, a, b, pattern)})
            more.append(rows)
        kinds = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("votes", pa.int32()), ("traits", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kinds[0]), pa.array(more, kinds[1])], ["doc_id", "base", "more"])


def decode_votes(code: int) -> list[int]:
    out = []
    for _ in range(LABELERS):
        out.append(code % 3 - 1)
        code //= 3
    return out[::-1]


def reliabilities(votes_: np.ndarray, counts: np.ndarray, rounds: int = 100, possible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """EM over distinct vote patterns: P(personal) of each, and each labeler's accuracy.

    A labeler that votes says yes with one probability to personal candidates and with
    another to the rest, so one that always says the same tells nothing; one that doesn't
    vote tells nothing either. Both begin at, and are drawn towards, four right in five, and
    yes is never the likelier for the rest, so that the two classes can't change places.
    Patterns that aren't ``possible`` are known not to be personal.
    """
    yes, cast, n = (votes_ == 1).astype(float), (votes_ != 0).astype(float), counts[:, None]
    hit, false, prior = np.full(votes_.shape[1], 0.8), np.full(votes_.shape[1], 0.2), PRIOR
    posterior = np.full(len(votes_), 0.5)
    for _ in range(rounds):
        logit = math.log(prior / (1 - prior)) + yes @ np.log(hit / false) + (cast - yes) @ np.log((1 - hit) / (1 - false))
        posterior = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        posterior = posterior if possible is None else np.where(possible, posterior, 0.0)
        prior = float(np.clip((posterior * counts).sum() / max(counts.sum(), 1), 0.05, 0.95))
        p = posterior[:, None]
        hit = ((yes * p * n).sum(axis=0) + 8) / ((cast * p * n).sum(axis=0) + 10)
        false = ((yes * (1 - p) * n).sum(axis=0) + 2) / ((cast * (1 - p) * n).sum(axis=0) + 10)
        middle = (hit + false) / 2
        hit, false = np.clip(np.maximum(hit, middle), 0.01, 0.99), np.clip(np.minimum(false, middle), 0.01, 0.99)
    p = posterior[:, None]
    right = ((yes * p + (cast - yes) * (1 - p)) * n).sum(axis=0)
    return posterior, (right + 8) / ((cast * n).sum(axis=0) + 10)


def bits(codes: np.ndarray) -> np.ndarray:
    return ((codes[:, None] >> np.arange(TRAITS)) & 1).astype(float)


def fit_classifier(codes: np.ndarray, positive: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression by gradient steps on (traits, expected positives, count) rows."""
    x = np.column_stack([np.ones(len(codes)), bits(codes)])
    w, total = np.zeros(x.shape[1]), max(counts.sum(), 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (positive - counts * p) / total - 1e-4 * w)
    return w


def resolve(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Disjoint spans of accepted (kind, start, end, logit), by start: the likeliest win.

    A span inside another of its kind goes into it, with the higher logit of the two, so
    that no part of a value stays out. Ties go to the earlier, then the longer span.
    """
    whole: list[tuple[str, int, int, float]] = []
    last: dict[str, int] = {}
    for kind, a, b, p in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if kind in last and b <= whole[last[kind]][2]:
            _, x, y, q = whole[last[kind]]
            whole[last[kind]] = (kind, x, y, max(p, q))
        else:
            last[kind] = len(whole)
            whole.append((kind, a, b, p))
    taken: list[tuple[int, int, str]] = []
    for kind, a, b, _ in sorted(whole, key=lambda s: (-s[3], s[1], -s[2], KINDS.index(s[0]))):
        at = bisect.bisect_left(taken, (a,))
        if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or taken[at][0] >= b):
            taken.insert(at, (a, b, kind))
    return [(kind, a, b) for a, b, kind in taken]


def _resolver(weights: dict[str, list[float]]):
    """Scores the candidates with their kind's weights and resolves the accepted."""
    least = math.log(THRESHOLD / (1 - THRESHOLD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            added = []
            for more in batch.column(2).to_pylist():
                scored = []
                for c in more:
                    w = weights[c["kind"]]
                    scored.append((c["kind"], c["start"], c["end"], w[0] + sum(v for i, v in enumerate(w[1:]) if c["traits"] >> i & 1)))
                added.append([{"kind": k, "start": a, "end": b} for k, a, b in resolve([c for c in scored if c[3] >= least])])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, kind)], ["doc_id", "base", "added"])

    return run


def learn(each: DataFrame) -> tuple[dict[str, list[float]], dict[str, dict]]:
    """Classifier weights of each kind, and what EM found: patterns, counts, posteriors, accuracies.

    ``each`` is (kind, votes, traits). Only counts come to the driver: by vote pattern, at
    most 3^7 a kind, and by trait pattern, at most 2^22 a kind.
    """
    seen = each.groupBy("kind", "votes").agg(F.count("*").alias("n")).orderBy("kind", "votes").collect()
    found, believed = {}, []
    for kind in sorted({r["kind"] for r in seen}):
        own = [r for r in seen if r["kind"] == kind]
        patterns, counts = np.array([decode_votes(r["votes"]) for r in own], dtype=float), np.array([r["n"] for r in own], dtype=float)
        # Capitals, digits or odd characters alone are no evidence.
        posterior, accuracy = reliabilities(patterns, counts, possible=(patterns[:, EVIDENCE] == 1).any(axis=1))
        found[kind] = {"patterns": patterns, "counts": counts, "posterior": posterior, "accuracy": accuracy}
        believed += [(kind, r["votes"], float(p)) for r, p in zip(own, posterior, strict=True)]
    if not believed:
        return {}, {}
    table = each.sparkSession.createDataFrame(believed, "kind string, votes int, p double")
    expected = each.join(F.broadcast(table), ["kind", "votes"]).groupBy("kind", "traits").agg(F.sum("p").alias("p"), F.count("*").alias("n")).orderBy("kind", "traits").collect()
    weights = {}
    for kind in found:
        own = [r for r in expected if r["kind"] == kind]
        weights[kind] = fit_classifier(np.array([r["traits"] for r in own]), np.array([r["p"] for r in own]), np.array([r["n"] for r in own], dtype=float)).tolist()
    return weights, found


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) of every row of (doc_id, text): arrays of (kind, start, end).

    Places are code points, ends exclusive. Texts are read once, whole; what the models
    learn comes from counts over all documents (see ``learn``), so nothing collected
    grows with the corpus. Null and empty texts have no spans; repeated rows keep their
    own row.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = written(docs.select("doc_id", "text").mapInArrow(_find, FOUND.format(kind=kind)), "pii-found")
    weights, _ = learn(found.select(F.explode("more").alias("c")).select("c.kind", "c.votes", "c.traits"))
    span = "array<struct<kind:string,start:long,end:long>>"
    if not weights:
        return found.select("doc_id", "base", F.expr("cast(array() as array<struct<kind:string,start:bigint,end:bigint>>)").alias("added"))
    return found.mapInArrow(_resolver(weights), f"doc_id {kind}, base {span}, added {span}")


def as_text(spans):
    """``kind:start:end`` joined by commas, by kind as listed, then start."""
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    sorted_ = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(sorted_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, digest and text of the spans of ``find_spans``."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", "added")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(F.encode(as_text(F.col("base")), "utf-8"), 256).alias("base_sha256"), as_text(every).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlaps merge."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
