"""Secret scans: base patterns, and a linear-chain conditional random field that adds spans.

Tokens (runs of other than white space) are tagged as outside a secret, its begin or its inside. A token's score for each tag
comes from its shape, the shapes of its neighbours and features of the whole file; tag changes score too. The weights maximise the
conditional likelihood of a bounded sample of texts: found base spans are its labels, and made-up secrets of other common
kinds are written into copies of the sample, so that the tagger learns secrets that the patterns don't know.
Viterbi decoding labels the tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm.common import slices, text_once

#: The field is fitted on about so many texts at most, chosen by a hash of the text, and on so many tokens of each.
TRAIN_TEXTS = 250
TRAIN_TOKENS = 24
#: Words of a text around a made-up example.
AROUND = 10
EPOCHS = 350
RATE, DECAY = 0.1, 0.001
SEED = 11
#: A worker keeps the shapes of words of so many letters together, and of as many that it met before.
KEPT_LETTERS = 600_000
KINDS = ("assign", "access", "hex", "crf")
MASK = "[SECRET]"

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Every match of ASSIGN holds one of these in lower case.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

KEYWORDS = re.compile(r"passw|pwd|secret|token|api.?key|auth|bearer|credential|private|access.?key|^basic$", re.IGNORECASE | re.ASCII)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk_", "sk-", "xox", "eyJ", "AIza", "glpat-", "-----BEGIN")
EDGES = "\"'`.,;()[]{}<>!?*#$%&"
#: A login in front of a host, as in scheme://name:pass@host.
LOGIN = re.compile(r"://[^\s/:@]*:[^\s/@]+@")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]{7,}", re.IGNORECASE | re.ASCII)
CHANGES = re.compile(r"(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Z]{2})[a-z]", re.ASCII)
#: Stretches of a word of one kind of letter, a capital taken with the small letters behind it.
STRETCH = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", re.ASCII)
#: How addresses of repositories and of data inside a page begin, and a query of a link.
ADDRESS = re.compile(r"^(?:git@|data:|mailto:|urn:|doi:|sha\d+[:-])|://[^\s?]*\?", re.IGNORECASE | re.ASCII)
#: Numbered names: an identifier in groups, and a name in capitals and numbers with short parts.
GROUPED = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
LOGIN_FLAG = re.compile(r"-u|--user(?:name)?|--login|-p|--password")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def shape(word: str) -> list[int]:
    """Numbers of the features that hold for a word."""
    core = word.strip(EDGES)
    n = len(core)
    out = [0, 1 + (n >= 6) + (n >= 12) + (n >= 20) + (n >= 32) + (n >= 48)]
    out += [15] * bool(KEYWORDS.search(core)) + [16] * (word[-1] in ":=")
    if core.isalpha():
        out += [7, 11 if core.islower() else 12 if core[:1].isupper() and core[1:].islower() else 13 if core.isupper() else 14]
        if n < 12:
            return out
    else:
        digits = sum(map(str.isdigit, core))
        out.append(7 + (digits > 0) + (digits > 0.2 * n) + (digits > 0.6 * n))
        lower, upper = any(map(str.islower, core)), any(map(str.isupper, core))
        out += [17] * lower + [18] * upper + [19] * (lower and upper and digits > 0)
        out += [20] * (n >= 8 and not core.strip("0123456789abcdefABCDEF"))
        out += [22] * ("@" in core) + [23] * ("://" in core or core.startswith("www.")) + [24] * ("." in core)
        out += [26] * ("_" in core or "-" in core) + [27] * ("+" in core or "/" in core) + [28] * (":" in core or "=" in core) + [29] * (n == 0)
        out += [30] * core.startswith(PREFIXES) + [35] * (LOGIN.search(core) is not None)
        out += [42] * (ADDRESS.search(core) is not None) + [43] * (GROUPED.fullmatch(core) is not None)
        out += [44] * (core.count(":") == 1 and "://" not in core and 0 < core.index(":") < n - 1) + [45] * (LOGIN_FLAG.fullmatch(word) is not None)
        # words and numbers in a row have longer stretches than what was drawn at random
        parts = STRETCH.findall(core)
        letters = [len(p) for p in parts if p[0].isalnum()]
        mean = sum(letters) / max(1, len(letters))
        out += [40] * (mean >= 2.5) + [41] * (mean >= 3.5)
        shortest = [p for p in re.split(r"[^A-Za-z0-9]+", core) if p]
        out += [46] * (len(shortest) > 1 and max(map(len, shortest)) <= 8) + [47] * (max(map(len, shortest), default=0) >= 20)
    out += [21] * (n >= 16 and re.fullmatch(r"[A-Za-z0-9+/_=-]+", core) is not None) + [25] * (not core.isascii())
    if n >= 8:
        bits = -sum(c / n * math.log2(c / n) for c in Counter(core).values())
        changes = len(CHANGES.findall(core))
        out.append(31 + (bits > 2.5) + (bits > 3.3) + (bits > 4))
        out += [36] * (changes >= 3) + [37] * (changes >= 6) + [38] * (CONSONANTS.search(core) is not None) + [39] * (changes * 5 > n)
    return out


FEATURES = 48
FILE_FEATURES = 4
#: Where the shapes that score a token stand: its own, the one before, behind and two before.
PLACES = (0, -1, 1, -2)


def file_features(words: list[str], text: str) -> np.ndarray:
    """Features of the whole file: code-like signs, a keyword anywhere, many digits, shortness."""
    n = max(len(text), 1)
    signs = text.count("=") + text.count("{") + text.count(";")
    return np.array([signs * 200 > n, any(w in text.lower() for w in ASSIGN_WORDS), sum(map(text.count, DIGITS)) * 10 > n, len(words) < 50], float)


class Field:
    """Weights: shapes at PLACES, file features and tag changes; tag scores are relative to OUTSIDE."""

    def __init__(self, emit: np.ndarray, file: np.ndarray, change: np.ndarray):
        self.emit, self.file, self.change = emit, file, change

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Viterbi tags for scores ``e`` (tokens, 3)."""
        n = len(e)
        # a path that leaves OUTSIDE must gain somewhere: without any gain all tokens are outside
        spare = max(0.0, float((self.change - self.change[0, 0]).max()))
        if not n or (e[:, 1:] - e[:, :1]).max() + 2 * spare <= 0:
            return np.zeros(n, np.int64)
        c = self.change.tolist()
        value = [e[0, 0], e[0, 1], -1e9]  # a secret starts with its begin
        back = []
        for x in e[1:].tolist():
            row, new = [], []
            for tag in range(3):
                best = max(range(3), key=lambda p: value[p] + c[p][tag])
                row.append(best)
                new.append(value[best] + c[best][tag] + x[tag])
            back.append(row)
            value = new
        tags = [max(range(3), key=lambda p: value[p])]
        for row in reversed(back):
            tags.append(row[tags[-1]])
        return np.array(tags[::-1])


class Sample:
    """Training sequences (words, tags, file features) as arrays with padding."""

    def __init__(self, sequences: list[tuple[list[str], list[int], np.ndarray]]):
        size, longest = len(sequences), max(len(w) for w, _, _ in sequences)
        x = np.zeros((size, longest, len(PLACES) * FEATURES + FILE_FEATURES), np.float32)
        self.tags, self.real = np.zeros((size, longest), np.int64), np.zeros((size, longest), bool)
        for s, (words, tags, file) in enumerate(sequences):
            shapes = [shape(w) for w in words]
            for t in range(len(words)):
                for k, place in enumerate(PLACES):
                    if 0 <= t + place < len(words):
                        x[s, t, [k * FEATURES + f for f in shapes[t + place]]] = 1
            x[s, : len(words), len(PLACES) * FEATURES :] = file
            self.tags[s, : len(words)], self.real[s, : len(words)] = tags, True
        #: Features of the tokens, without padding.
        self.flat = x[self.real]

    def slopes(self, w: np.ndarray, change: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(negative mean log likelihood with the decay of ``w``, its gradients for ``w`` and ``change``), by forward and backward sums."""
        (size, longest), real = self.tags.shape, self.real
        e = np.zeros((size, longest, 3))
        e[real] = self.flat @ w.astype(self.flat.dtype)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + START
        for t in range(1, longest):
            step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + change, axis=1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], step, alpha[:, t - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for t in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(change + (e[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(real[:, t + 1, None], step, 0.0)
        gold = np.eye(3)[self.tags] * real[:, :, None]
        before, after = self.tags[:, :-1][real[:, 1:]], self.tags[:, 1:][real[:, 1:]]
        pairs = np.zeros((3, 3))
        np.add.at(pairs, (before, after), 1)
        loss = (z.sum() - (e * gold).sum() - START[self.tags[:, 0]].sum() - change[before, after].sum()) / size + DECAY / 2 * (w * w).sum()
        marginal = np.exp(alpha + beta - z[:, None, None]) * real[:, :, None]
        both = np.exp(alpha[:, :-1, :, None] + change + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None])
        both = (both * real[:, 1:, None, None]).sum((0, 1))
        d = self.flat.T @ (marginal - gold)[real].astype(self.flat.dtype) / size + DECAY * w
        return loss, d, (both - pairs) / size


#: Inside never follows outside, and a secret starts with its begin.
NEVER = -20.0
START = np.array([0.0, 0.0, NEVER])


def fit(sequences: list[tuple[list[str], list[int], np.ndarray]], epochs: int = EPOCHS) -> Field:
    """Maximum conditional likelihood by full-batch Adam; sequences are (words, tags, file features)."""
    ordered = sorted(sequences, key=lambda s: len(s[0]))
    cuts = [0, len(ordered) // 2, len(ordered) * 7 // 8, len(ordered)]  # sequences of like length are padded together
    samples = [(Sample(ordered[a:b]), (b - a) / len(ordered)) for a, b in zip(cuts, cuts[1:]) if b > a]
    w, change = np.zeros((samples[0][0].flat.shape[1], 3)), np.zeros((3, 3))
    change[OUTSIDE, INSIDE] = NEVER
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(change), np.zeros_like(change)]
    for epoch in range(1, epochs + 1):
        parts = [(share, sample.slopes(w, change)) for sample, share in samples]
        grads = [sum(share * found[k] for share, found in parts) for k in (1, 2)]
        grads[1][OUTSIDE, INSIDE] = 0
        for k, (value, grad) in enumerate(zip((w, change), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    n = len(PLACES) * FEATURES
    return Field(w[:n].reshape(len(PLACES), FEATURES, 3), w[n:], change)


LOWER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
MIXED = LOWER + LOWER.upper() + DIGITS


def some(rng: random.Random, n: int, alphabet: str) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def spoken(rng: random.Random, low: int = 1, high: int = 5) -> str:
    """A made-up word of open and closed syllables."""
    return "".join(rng.choice("bcdfghjklmnprstvwz") + rng.choice(["a", "e", "i", "o", "u", "ei", "au", "er", "on", "al", "ü", "é"]) for _ in range(rng.randint(low, high)))


def made_up(rng: random.Random) -> tuple[list[str], list[int]]:
    """(words, tags) of a made-up secret as it stands in files."""
    name = rng.choice(["password", "pwd", "db_password", "secret", "client_secret", "token", "auth_token", "api-key", "API_KEY", "credential", "private_key"])
    kind = rng.choice([*range(12), 8, 9, 9])
    if kind == 0:
        return ["Authorization:", rng.choice(["Bearer", "Basic"]), some(rng, rng.randrange(24, 60), MIXED + "-_.")], [0, 0, 1]
    if kind == 1:
        return [rng.choice(["ghp_", "gho_", "sk_live_", "sk-", "xoxb-", "glpat-", "AIza"]) + some(rng, rng.randrange(20, 40), MIXED)], [1]
    if kind == 2:
        return [name, rng.choice(["is", "=", ":", "->"]), some(rng, rng.randrange(8, 24), MIXED + "!#%&")], [0, 0, 1]
    if kind == 3:
        return [f"{name}:", some(rng, rng.randrange(8, 40), MIXED)], [0, 1]
    if kind == 4:
        return ["eyJ" + some(rng, 20, MIXED) + "." + some(rng, 40, MIXED) + "." + some(rng, 30, MIXED + "-_")], [1]
    if kind == 5:
        lines = [some(rng, 64, MIXED + "+/") for _ in range(rng.randrange(2, 5))]
        sort = rng.choice([[], ["RSA"], ["EC"], ["OPENSSH"]])
        return ["-----BEGIN", *sort, "PRIVATE", "KEY-----", *lines, "-----END", *sort, "PRIVATE", "KEY-----"], [1] + [2] * (5 + 2 * len(sort) + len(lines))
    if kind == 6:
        return [some(rng, rng.randrange(32, 64), MIXED + "+/") + rng.choice(["==", "=", ""])], [1]
    if kind == 7:
        scheme, host = rng.choice(["postgres", "mysql", "mongodb", "redis", "https", "amqp"]), spoken(rng, 1, 3)
        return [f"{scheme}://{spoken(rng, 1, 2)}:{rng.choice([spoken(rng, 2, 4) + some(rng, 2, DIGITS), some(rng, rng.randrange(6, 20), MIXED)])}@{host}.example.org/{spoken(rng, 1, 2)}"], [1]
    if kind == 8:
        login = f"{spoken(rng, 1, 2)}:{rng.choice([spoken(rng, 2, 3) + some(rng, rng.randrange(1, 4), DIGITS), some(rng, rng.randrange(6, 20), MIXED + '!#%')])}"
        return [*rng.choice([["curl"], ["curl", "-s"], ["wget"], ["http"]]), rng.choice(["-u", "--user"]), login, f"https://{spoken(rng, 1, 3)}.example.org/{spoken(rng, 1, 2)}"], [0] * 10
    if kind == 9:
        short = rng.choice([spoken(rng, 2, 4) + some(rng, rng.randrange(1, 5), DIGITS), spoken(rng, 1, 3).capitalize() + rng.choice("!#%") + some(rng, 3, DIGITS), some(rng, rng.randrange(8, 14), MIXED)])
        return [rng.choice(["the", "my", "our", "new"]), rng.choice(["pwd", "password", "passphrase", "secret", "token"]), rng.choice(["is", "was", "now:", "="]), short], [0, 0, 0, 1]
    if kind == 10:
        return [rng.choice(["key", "apikey", "x-api-key:", "bearer", "signature="]), some(rng, rng.randrange(20, 48), MIXED + "-_")], [0, 1]
    return [name, "=", '"' + some(rng, rng.randrange(12, 40), MIXED) + '"'], [0, 0, 1]


def secret_of(rng: random.Random) -> tuple[list[str], list[int]]:
    """A made-up secret with a tag for each word; a login behind a flag is tagged as a whole."""
    words, tags = made_up(rng)
    if len(tags) != len(words):
        tags = [1 if before in ("-u", "--user") else 0 for before in ["", *words[:-1]]]
    return words, tags


def made_clean(rng: random.Random) -> list[str]:
    """Words that look odd and are no secrets: numbers, addresses, links, dates, names of things, long words, marked words."""
    word, other = spoken(rng), spoken(rng)
    number = some(rng, rng.choice([4, 8, 10, 12, 16, 16, 16, 19]), DIGITS)
    return rng.choice(
        [
            [number],
            [f"{word}.{number[:2]}@{other}{number[0]}.example.com"],
            [f"{word}.{other}@{spoken(rng, 1, 3)}.example.com"],
            [f"20{number[:2]}-0{number[0]}-1{number[1]}T1{number[2]}:2{number[3]}:30Z", f"{word}@{other}.example.org"],
            [rng.choice(["to", "from", "mail"]), f"<{other}.{word}@{spoken(rng, 1, 3)}.example.net>"],
            [rng.choice(["id", "run", "see"]), "-".join(some(rng, n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))],
            [f"https://www.{word}.example.org/{other}/{number[:3]}?page={number[0]}"],
            [f"https://{word}.example.org/{other}-{word}/{other}.html"],
            [f"({number[:3]})", f"555-{number[:4]}"],
            ["-".join(number[i : i + 4] for i in range(0, len(number), 4))],
            [word * 2 + rng.choice([".###", "$$$", "%%%", "&&&", "!!", "***"])],
            [f"20{number[:2]}-0{number[0]}-1{number[1]}"],
            [word.upper() * 2 + rng.choice(["", "!!", "."])],
            [spoken(rng, 6, 16).capitalize()],
            [spoken(rng, 6, 16)],
            [f"{word}_{other}_{spoken(rng)}{rng.choice(['', '()', ' =', '1'])}"],
            ["".join(spoken(rng, 1, 3).capitalize() for _ in range(rng.randint(2, 4)))],
            [f"/{word}/{other}/{spoken(rng)}.{rng.choice(['py', 'txt', 'json'])}"],
            [f"v{number[0]}.{number[1]}.{number[2]}-{word}"],
            [f"{word}-{other}-{spoken(rng)}-{number[:2]}"],
            [rng.choice(["password", "secret", "token"]), rng.choice(["is", "was", "of", "for"]), word],
            [f"{word}={number[0]};", f"{other}={{"],
            ["-".join(some(rng, n, "0123456789abcdef") for n in (8, 4, 4, 4, 12))],
            *odd_names(rng),
        ]
    )


def odd_names(rng: random.Random) -> list[list[str]]:
    """Names in letters and numbers that people and machines give to things, one of each kind."""
    word, other, number = spoken(rng, 1, 3), spoken(rng, 1, 3), some(rng, 8, DIGITS)
    letters = lambda low, high: some(rng, rng.randint(low, high), LOWER).upper()
    code = f"{letters(2, 5)}{rng.choice(['-', '', '_'])}{number[: rng.randint(1, 4)]}{rng.choice(['', '', 'a', 'b2', 'X'])}"
    parts = [rng.choice([spoken(rng, 1, 3), spoken(rng, 1, 2).capitalize(), number[: rng.randint(1, 4)], letters(2, 4)]) for _ in range(rng.randint(3, 6))]
    return [
        ["".join(p.capitalize() if p.islower() else p for p in parts)],
        [rng.choice(["i", "e", "x", ""]) + word.capitalize() + number[:2] + "".join(rng.choice(["Pro", "Max", "Plus", "Mini", "Ultra"]) for _ in range(2)) + f"20{number[2:4]}" + rng.choice(["", other.capitalize()])],
        [code],
        [code, f"{letters(2, 4)}{number[:3]}{rng.choice(LOWER)}{number[3]}", f"{letters(3, 5)}-{letters(1, 1)}{spoken(rng, 1, 1)}-{number[4]}"],
        [f"{rng.choice(['m', 'si', 'mi', 't', 'r'])}RNA-{number[:4]}", code],
        [f"git@{word}.example.org:{other}/{spoken(rng, 1, 2).capitalize()}{number[0]}.git"],
        [f"data:{rng.choice(['image/png', 'image/gif', 'font/woff2', 'text/plain'])};base64,{some(rng, rng.randrange(8, 60), MIXED + '+/')}{rng.choice(['', '=', '=='])}"],
        [f"https://{word}.example.org/{other}/{some(rng, rng.randrange(4, 12), MIXED)}?{rng.choice(['utm_source', 'v', 'id', 'ref', 'sid'])}={some(rng, rng.randrange(6, 24), MIXED)}"],
        [rng.choice(["commit", "rev", "at"]), some(rng, rng.choice([7, 8, 10, 12]), "0123456789abcdef")],
        [some(rng, rng.choice([7, 8, 10, 12]), "0123456789abcdef")],
        ["/".join(parts)],
        ["/" + "/".join(p.lower() for p in parts) + rng.choice([".py", ".so.1", ".tar.gz", "", "/"])],
        ["_".join(parts)],
        ["-".join(parts)],
        [".".join(p.lower() for p in parts)],
        ["::".join(p.capitalize() for p in parts[:3]) + rng.choice(["", "()"])],
        [f"{word.capitalize()}/{other.capitalize()}_{spoken(rng, 1, 2).capitalize()}"],
        [f"application/vnd.{word}.{other}+{rng.choice(['xml', 'json'])};charset=utf-{rng.choice('8')}"],
        [f"C{number[0]}H{number[1:3]}N{number[3]}O{number[4]}"],
        [f"{number[:2]}:{number[2:4]}:{number[4:6]}.{number}"],
        [f"{letters(2, 2)}{number}{some(rng, 10, DIGITS)}"],
        [f"978-{number[0]}-{number[1:3]}-{some(rng, 6, DIGITS)}-{number[3]}"],
        [f"user:{word}", f"{word}:{other}", f"{word}:{number[:4]}"],
    ]


def train(docs: DataFrame, text: str = "text", texts: int = TRAIN_TEXTS) -> Field:
    """Fit the field; the driver gets at most 2 * ``texts`` excerpts of TRAIN_TOKENS tokens, half of them around base spans.

    The different texts with the least hashes are taken, and as many of those that a base pattern may match, so how rows
    are dealt to tasks or repeated changes nothing. Null texts are left out; an empty table gives a field of made-up secrets.
    """
    rows = docs.select(F.col(text).cast("string").alias("text")).where("text IS NOT NULL")
    total = max(1, rows.count())
    rows = rows.withColumn("mark", F.shiftrightunsigned(F.xxhash64("text", F.lit(SEED)), 1))
    likely = F.col("text").rlike("(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]") | F.col("text").rlike("AKIA[A-Z0-9]{16}")

    def up_to(share: float, which: Column) -> int:
        """The mark up to which ``texts`` different texts lie, looked for among a share of all marks."""
        few = rows.where(F.col("mark") <= int(min(1.0, share) * ((1 << 63) - 1024)))
        found = few.where(which).select("mark").distinct().orderBy("mark").limit(texts).collect()
        return found[-1][0] if found else -1

    def excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a copied text leaves each task once
        for batch in batches:
            marks, words, tags, files = [], [], [], []
            for t, mark in zip(batch.column(0), batch.column(1).to_pylist()):
                tokens = [] if mark in seen else list(re.finditer(r"\S+", t.as_py()))
                seen.add(mark)
                if tokens:
                    tagged = tags_of(tokens, base_spans(t.as_py()))
                    first = max(0, tagged.index(BEGIN) - TRAIN_TOKENS // 2) if BEGIN in tagged else len(tokens) // 3
                    cut = slice(first, first + TRAIN_TOKENS)
                    marks.append(mark)
                    words.append([m.group() for m in tokens[cut]])
                    tags.append(tagged[cut])
                    files.append(file_features(words[-1], t.as_py()).tolist())
            columns = [pa.array(marks, pa.int64()), pa.array(words, pa.list_(pa.string())), pa.array(tags, pa.list_(pa.int32())), pa.array(files, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["mark", "words", "tags", "files"])

    plain, marked = up_to(4 * texts / total, F.lit(True)), up_to(80 * texts / total, likely)
    chosen = rows.where((F.col("mark") <= plain) | ((F.col("mark") <= marked) & likely))
    found = chosen.mapInArrow(excerpts, "mark long, words array<string>, tags array<int>, files array<double>").dropDuplicates(["mark"]).collect()
    found = sorted((list(map(str, r["words"])), list(r["tags"]), list(r["files"])) for r in found)
    return fit(with_examples(found))


def with_examples(found: list[tuple[list[str], list[int], list[float]]]) -> list[tuple[list[str], list[int], np.ndarray]]:
    """Excerpts (words, tags, file features), and copies of those without a secret with made-up secrets and odd clean words in them."""
    rng = random.Random(SEED)
    filler = [(["the", "of", "and", "a", "in", "it"] * 4, [0] * 24, [0.0] * FILE_FEATURES)]
    sequences = [(w, t, np.array(f)) for w, t, f in found or filler]
    plain_ones = [s for s in sequences if not any(s[1])] or [(w, t, np.array(f)) for w, t, f in filler]
    for _ in range(max(500, len(plain_ones) // 2)):
        for new, marks in (secret_of(rng), *((made_clean(rng), None) for _ in range(5))):
            words, tags, file = rng.choice(plain_ones)
            first = rng.randrange(max(1, len(words) - AROUND))  # scores look two words far
            words, tags = words[first : first + AROUND], tags[first : first + AROUND]
            if rng.random() < 0.3:  # alone or among few words
                few = rng.randrange(4)
                words, tags = words[:few], tags[:few]
                file = file_features(words + new, " ".join(words + new))
            at = rng.randrange(len(words) + 1)
            sequences.append(([*words[:at], *new, *words[at:]], [*tags[:at], *(marks or [0] * len(new)), *tags[at:]], file))
    return sequences


def tags_of(tokens: list[re.Match], spans: list[tuple[int, int, str]]) -> list[int]:
    """Tags of tokens that overlap spans; of an assignment only the value counts, which is its last token."""
    out = [OUTSIDE] * len(tokens)
    starts = np.array([m.start() for m in tokens], np.int64)
    for _, end, _ in spans:
        out[int(np.searchsorted(starts, end - 1, side="right")) - 1] = BEGIN
    return out


class Scanner:
    """Finds all spans of a text; keeps the shapes of words it has met, up to a bound, and the scores of shapes."""

    def __init__(self, field: Field):
        self.field, self.row, self.old, self.letters, self.shapes = field, {}, {}, 0, {}
        self.scores = np.zeros((0, len(PLACES), 3), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        new = set(words).difference(self.row)
        self.letters += sum(map(len, new))
        if self.letters > KEPT_LETTERS:  # the words of late become the old ones
            self.old, self.row, new = self.row, {}, set(words)
            self.letters = sum(map(len, new))
        known = {w: self.old[w] for w in new if w in self.old}
        self.row.update(known)
        new = new.difference(known)
        for w in new:
            found = tuple(shape(w))
            if found not in self.shapes:  # far fewer than words
                self.shapes[found] = len(self.shapes)
                self.scores = np.concatenate([self.scores, self.field.emit[:, found, :].sum(axis=1)[None].astype(np.float32)])
            self.row[w] = self.shapes[found]
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, kind) by start and kind: all base spans, and tagged ones that don't overlap them."""
        base = base_spans(text)
        words = text.split()
        if not words:
            return base
        s = self.scores_of(words, text)
        tags = self.field.decode(s)
        if not tags.any():
            return base
        tokens = [m.span() for m in re.finditer(r"\S+", text)]
        if len(tokens) != len(words):  # split() knows a few more separators; keep to one reading
            words = [text[a:b] for a, b in tokens]
            tags = self.field.decode(self.scores_of(words, text))
        found, at = [], np.flatnonzero(tags == BEGIN).tolist()
        for k in at:
            end = k
            while end + 1 < len(tags) and tags[end + 1] == INSIDE:
                end += 1
            a, b = tokens[k][0], tokens[end][1]
            body = text[a:b]
            a, b = a + len(body) - len(body.lstrip(EDGES)), b - len(body) + len(body.rstrip(EDGES))
            if a < b and not any(x < b and a < y for x, y, _ in base):
                found.append((a, b, KINDS[3]))
        return sorted(base + found, key=lambda x: (x[0], KINDS.index(x[2])))

    def scores_of(self, words: list[str], text: str) -> np.ndarray:
        rows = self._rows(words)
        e = self.scores[rows, 0].astype(float)
        e[1:] += self.scores[rows[:-1], 1]
        e[:-1] += self.scores[rows[1:], 2]
        e[2:] += self.scores[rows[:-2], 3]
        return e + file_features(words, text) @ self.field.file


def _map(docs: DataFrame, field: Field, text: str, names: list[str], kinds: list, make) -> DataFrame:
    """``docs`` with columns ``names`` made from each text and its spans; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights
    keep = [c for c in docs.columns if c not in names]
    rows, at = text_once(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        for batch in slices(batches, at):
            made = [make(t, scanner.spans(t or "")) for t in batch.column(at).to_pylist()]
            new = [pa.array([m[k] for m in made], kind) for k, (kind, _) in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *new], [*keep, *names])

    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, kind) for n, (_, kind) in zip(names, kinds))])
    return rows.mapInArrow(run, schema)


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets`` added: an array of (start, end, kind) in code points, end exclusive, by start and kind.

    Every whole text is scanned; a null or empty text has none. Base spans always stay; tagged spans (kind crf) that overlap
    one are left out. Rows are independent, so repeated rows, null keys and empty tables need no care.
    """
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    kind = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))
    return _map(docs, field, text, ["secrets"], [(pair, kind)], lambda t, s: ([{"start": a, "end": b, "kind": k} for a, b, k in s],))


def redact(docs: DataFrame, field: Field, text: str = "text", mask: str = MASK) -> DataFrame:
    """``docs`` with each found secret replaced by ``mask``; overlapping spans become one. Texts without secrets don't change."""

    def cover(t: str | None, spans: list[tuple[int, int, str]]) -> tuple[str | None]:
        if not spans:
            return (t,)
        out, last = [], 0
        for a, b, _ in spans:
            if a >= last:
                out += [t[last:a], mask]
            last = max(last, b)
        return ("".join([*out, t[last:]]),)

    order = docs.columns
    return _map(docs, field, text, [text], [(pa.string(), T.StringType())], cover).select(*[f"`{c}`" for c in order])


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find(docs, train(docs)).select("doc_id", "secrets")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id", *map(count, KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans")
    )
