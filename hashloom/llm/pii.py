"""Personal data by candidate gradient boosting, in DataFrame and SQL functions alone.

Base patterns give spans that always stay. Several high-recall generators propose further spans that overlap each other (runs of digit
groups, cards, telephone numbers and national numbers within them, account numbers, spelled-out or odd addresses); boosted trees score each from its format and its
context. Of overlapping candidates the one of the highest score goes on, and it is added if it reaches the threshold of its kind, which is
calibrated on held-out examples. The trees are fitted in the driver on generated examples whose features come from the same SQL, a candidate
being right only if it is the whole span and nothing else, then run as one SQL expression.

Places are code points, ends exclusive: a text is split at a pattern's matches, and the lengths of the pieces give the places.
The patterns are written so that no text, however long, makes them backtrack (possessive groups, starts only where a run starts).

Odd input: a null text is an empty one (no spans); repeated rows and null doc_ids are kept; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .shared import id_and_text

KINDS = ("email", "ip", "card", "phone")
#: The base patterns; each equals the plain one of its kind on every text, leftmost and without overlaps.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates, overlapping by design: runs of digit groups; what may be a card, a telephone number or a national number by
#: itself, also within such a run; account numbers; addresses with odd or spelled-out parts.
GENERATORS = {
    "digits": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[().\x20/-]{0,3}[0-9]){6,}+",
    "card": r"(?<![0-9])(?:[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([\x20-]?)[0-9]{6}\2[0-9]{5})(?![0-9])",
    "number": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "national": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "address": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[\[({](?i:at)[\])}])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({](?i:dot)[\])}])\x20?[A-Za-z0-9-]++)*+",
    "spelled": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20(?i:dot)\x20[A-Za-z0-9_-]++){0,4}+\x20(?i:at)\x20[A-Za-z0-9-]++(?:\x20(?i:dot)\x20[A-Za-z0-9-]++){1,4}+",
}
#: What must stand in a text for a pattern to be tried; every match holds it.
GATES = {
    "email": "contains(text, '@')", "ip": "text rlike '[0-9]\\.[0-9]'", "card": "text rlike '[0-9][ -]?[0-9]'", "phone": "contains(text, '+')", "digits": "text rlike '[0-9]'",
    "g_card": "text rlike '[0-9]{4}'", "g_number": "text rlike '[0-9]{3}'", "g_national": "text rlike '-[0-9]{2}-'", "g_account": "text rlike '[A-Z]{2}[0-9]{2}'",
    "g_address": "contains(text, '@') or text rlike '(?i)[(\\\\[{]at[)\\\\]}]'", "g_spelled": "text rlike '(?i) dot '",
}
GATES["g_digits"] = GATES["digits"]
#: Kinds of added spans besides the base ones; their order follows that of KINDS.
MORE_KINDS = ("national", "account")
FEATURES = (
    "digits", "length", "groups", "plus", "luhn", "ip", "dots", "dashes", "parens", "letters", "at", "longest", "shortest", "slashes", "date", "cue_phone", "cue_card", "cue_mail", "cue_ip", "cue_other", "cue_id", "prior_letter",
    "joined_before", "joined_after", "check97", "generator", "dot_part", "known_end",
)
CONTEXT = 24
ROUNDS, DEPTH, RATE, LEAVES_MIN, PRECISION = 60, 4, 0.2, 6, 0.97


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(name: str, pattern: str) -> str:
    """SQL: array of struct(start, end, m) of the pattern's matches in column `text`."""
    none = "cast(array() as array<struct<start:int,end:int,m:string>>)"
    p = _quoted(pattern)
    walk = (
        f"aggregate(sequence(1, size(ms)), struct(0 as at, {none} as out), (a, i) -> struct("
        "a.at + char_length(pieces[i - 1]) + char_length(ms[i - 1]) as at, "
        "array_append(a.out, struct(a.at + char_length(pieces[i - 1]) as start, a.at + char_length(pieces[i - 1]) + char_length(ms[i - 1]) as end, ms[i - 1] as m)) as out)).out"
    )
    # one-element arrays bind the matches and the pieces to names
    bound = f"transform(array(regexp_extract_all(text, {p}, 0)), ms -> if(size(ms) = 0, {none}, transform(array(split(text, {p}, -1)), pieces -> {walk})[0]))[0]"
    return f"case when {GATES[name]} then {bound} else {none} end"


_DIGITS = "regexp_replace(s.m, '[^0-9]', '')"
_IP = "forall(split(s.m, '[.]'), x -> char_length(ltrim('0', x)) <= 3 and coalesce(cast(nullif(ltrim('0', x), '') as int), 0) <= 255)"
#: Which matches of a base pattern are kept.
VALID = {
    "email": "true",
    "ip": _IP,
    "card": f"char_length({_DIGITS}) between 14 and 19 and luhn_check({_DIGITS})",
    "phone": f"char_length({_DIGITS}) between 10 and 15",
}


#: The remainder by 97 of an account number, its first four characters moved to the end and letters as numbers from 10 on.
_CHECK = "aggregate(filter(split(concat(substring({0}, 5), substring({0}, 1, 4)), ''), c -> c <> ''), 0, (a, c) -> if(c rlike '[0-9]', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def _features(s: str = "s") -> str:
    """SQL: array<double> of a candidate's features, in the order of FEATURES."""
    m = f"{s}.m"
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    before = f"lower(substring(text, greatest({s}.start - {CONTEXT - 1}, 1), least({s}.start, {CONTEXT})))"
    after = f"substring(text, {s}.end + 1, 2)"
    count = lambda chars: f"char_length({m}) - char_length(translate({m}, '{chars}', ''))"
    flag = lambda c: f"if({c}, 1, 0)"
    ip = "forall(split({0}, '[.]'), x -> x rlike '^[0-9]{{1,3}}$' and cast(x as int) <= 255) and size(split({0}, '[.]')) = 4".format(m)
    parts = [
        f"char_length({digits})",
        f"char_length({m})",
        f"size(filter(split({m}, '[^0-9]+'), x -> x <> ''))",
        flag(f"{m} like '+%'"),
        flag(f"char_length({digits}) between 13 and 19 and luhn_check({digits})"),
        flag(ip),
        count("."),
        count("-"),
        count("()"),
        f"char_length(regexp_replace({m}, '[^A-Za-z]', ''))",
        flag(f"{m} rlike '@|(?i)[(\\\\[{{ ]at[)\\\\]}} ]'"),
        f"array_max(transform(split({m}, '[^0-9]+'), x -> char_length(x)))",
        f"coalesce(array_min(filter(transform(split({m}, '[^0-9]+'), x -> char_length(x)), n -> n > 0)), 0)",
        count("/"),
        flag(f"{m} rlike '(^|[^0-9])(19|20)[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}([^0-9]|$)|(^|[^0-9])[0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.](19|20)[0-9]{{2}}([^0-9]|$)'"),
        flag(f"{before} rlike 'phone|tel|call|mobile|fax|cell|whatsapp|sms|dial|ring|text'"),
        flag(f"{before} rlike 'card|visa|master|credit|debit|amex|account|iban|pay|bank'"),
        flag(f"{before} rlike 'mail|contact|write|reach'"),
        flag(f"{before} rlike '\\\\bip\\\\b|host|server|address|login'"),
        flag(f"{before} rlike 'version|order|isbn|page|ticket|invoice|no[.]|ref|sku|release|date|total|price|score|serial|[#$=*]'"),
        flag(f"{before} rlike 'ssn|social|security|national|passport|tax|insurance'"),
        flag(f"{before} rlike '[a-z]$'"),
        flag(f"{before} rlike '[0-9][-./ ]{{0,2}}$'"),
        flag(f"{after} rlike '^[-./ ]?[0-9]'"),
        flag(f"{s}.g = 'account' and {_CHECK.format(f'translate({m}, chr(32), {chr(39) * 2})')} = 1"),
        f"array_position({_names()}, {s}.g)",
        flag(f"{m} rlike '(?i)[A-Za-z0-9]([.]| ?[(\\\\[{{]dot[)\\\\]}}] ?| dot )[A-Za-z]{{2,}}$'"),
        flag(f"{m} rlike '(?i)(com|org|net|edu|gov|info|io|eu|de|fr|es|it|nl|at|ch|uk|us|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|be|pt|biz|co)$'"),
    ]
    return "array(" + ", ".join(f"cast({p} as double)" for p in parts) + ")"


def _names() -> str:
    return "array(" + ", ".join(f"'{g}'" for g in GENERATORS) + ")"


def _luhn(rng: random.Random, n: int, valid: bool = True) -> str:
    body = [rng.randint(0, 9) for _ in range(n - 1)]
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(body)))
    return "".join(map(str, body)) + str((10 - total % 10 + (0 if valid else rng.randint(1, 9))) % 10)


def _account(rng: random.Random, valid: bool = True) -> str:
    """A country's letters, two check digits and the rest."""
    rest = "".join(rng.choice("0123456789") for _ in range(rng.choice((14, 16, 18, 20))))
    if rng.random() < 0.3:
        rest = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(4)) + rest[4:]
    land = rng.choice(("DE", "FR", "GB", "ES", "NL", "IT", "AT"))
    check = 98 - int("".join(str(int(c, 36)) for c in f"{rest}{land}00")) % 97
    return f"{land}{(check if valid else (check + rng.randint(1, 90)) % 97):02}{rest}"


def examples(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str]]:
    """(text before, core, text after): made by rule; a core that is personal is marked by a kind before its text, `kind|core`."""
    rng = random.Random(seed)
    d = lambda k: "".join(str(rng.randint(0, 9)) for _ in range(k))
    word = lambda: "".join(rng.choice("aeiourstlnm") for _ in range(rng.randint(3, 8)))
    filler = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    space = lambda s, k, sep: sep.join(s[i : i + k] for i in range(0, len(s), k))
    at = lambda: rng.choice((" (at) ", "[at]", " [at] ", "(at)", " {at} "))
    dot = lambda: rng.choice((" (dot) ", "[dot]", " [dot] ", "(dot)"))
    area = lambda: f"{rng.randint(2, 9)}{d(2)}"
    end = lambda: rng.choice(("com", "org", "net", "de", "info", "edu", "co", "uk", "io"))
    makers = {
        "phone": [lambda: f"({area()}) {d(3)}-{d(4)}", lambda: f"{area()}-{d(3)}-{d(4)}", lambda: f"{area()} {d(3)} {d(4)}", lambda: f"{area()}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"0{d(3)}/{d(7)}", lambda: f"0{d(2)} {d(4)} {d(4)}"],
        "card": [lambda: space(_luhn(rng, 16), 4, rng.choice((" ", "-"))), lambda: _luhn(rng, rng.choice((15, 16))), lambda: (lambda c: f"{c[:4]} {c[4:10]} {c[10:]}")(_luhn(rng, 15))],
        "email": [lambda: f"{word()}.{word()}{at()}{word()}{dot()}{end()}", lambda: f"{word()}{at()}{word()}{dot()}{end()}", lambda: f"{word()}{d(2)} @ {word()}.{end()}", lambda: f"{word()}{at()}{word()}.{end()}", lambda: f"{word()} dot {word()} at {word()} dot {end()}", lambda: f"{word()} at {word()} dot {end()}"],
        "national": [lambda: f"{rng.randint(1, 8)}{d(2)}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"],
        "account": [lambda: _account(rng), lambda: space(_account(rng), 4, " ")],
    }
    other = [
        lambda: f"{rng.randint(1950, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}",
        lambda: f"{rng.randint(1, 28):02}/{rng.randint(1, 12):02}/{rng.randint(1950, 2035)}",
        lambda: f"{rng.randint(1950, 2035)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02} {d(2)}:{d(2)}",
        lambda: _luhn(rng, 16, False),
        lambda: space(_luhn(rng, 16, False), 4, rng.choice((" ", "-"))),
        lambda: d(rng.randint(7, 13)),
        lambda: f"{d(2)}.{d(3)}.{d(3)}",
        lambda: f"{d(1)},{d(3)},{d(3)}.{d(2)}",
        lambda: " ".join(d(rng.randint(1, 2)) for _ in range(rng.randint(6, 14))),
        lambda: " ".join(str(rng.randint(100, 999)) for _ in range(rng.randint(5, 9))),
        lambda: f"{rng.randint(300, 999)}.{d(3)}.{rng.randint(256, 999)}.{d(2)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"{d(1)}.{d(10)}",
        lambda: f"{rng.randint(1990, 2030)} {rng.randint(1990, 2030)} {rng.randint(1990, 2030)}",
        lambda: f"{word()} @ {word()}",
        lambda: f"{word()}@{word()}",
        lambda: f"look at {word()} dot",
        lambda: f"{word()} at the dot {word()}",
        lambda: _account(rng, False),
        lambda: " ".join(["".join(rng.choice("ABCDEFGHKLMNPRSTUVWXYZ") for _ in range(2)) + d(2), *(d(4) for _ in range(rng.randint(2, 4)))]),
    ]
    cues = {"phone": ("phone", "tel", "call me at", "mobile", "dial", "fax"), "card": ("card", "visa", "credit card no", "paid with"), "email": ("mail", "contact", "write to"), "national": ("ssn", "social security number", "ssn no"), "account": ("iban", "bank account", "account")}
    plain = ("order", "version", "isbn", "invoice", "ticket #", "page", "total", "ref", "serial")
    tails = {"card": (f" {rng.randint(1, 12):02}/{rng.randint(24, 32)}", f" {d(3)}", ""), "phone": (f" {rng.randint(2000, 2030)}-01-02", f" ext {d(2)}", "")}
    out = []
    for _ in range(n):
        kind = rng.choice((*makers, "other", "other", "other", "other", "bare"))
        lead = rng.choice((": ", " ", ", ", " ", ",", " - "))
        if kind == "other":
            out.append((f"{filler()} {rng.choice(plain) if rng.random() < 0.6 else filler()}{lead}", "|" + rng.choice(other)(), f" {filler()}"))
        elif kind == "bare":  # ten digits are personal only where their context says so
            out.append((f"{filler()} {rng.choice(cues['phone'])}{lead}", "phone|" + d(10), f" {filler()}"))
        else:
            tail = rng.choice(tails.get(kind, ("",))) if rng.random() < 0.5 else ""
            out.append((f"{filler()} {rng.choice(cues[kind]) if rng.random() < 0.6 else filler()}{lead}", f"{kind}|{rng.choice(makers[kind])()}", f"{tail} {filler()}"))
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
    """A regression tree on gradients: nested (feature, cut, left, right), leaves as numbers."""
    leaf = float(-g.sum() / (h.sum() + 1.0)) * RATE
    if depth == 0 or len(g) < 2 * LEAVES_MIN:
        return leaf
    best, whole = (1e-6, None, None), g.sum() ** 2 / (h.sum() + 1)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v, gs, hs = x[order, k], np.cumsum(g[order]), np.cumsum(h[order])
        at = np.flatnonzero(v[1:] != v[:-1])  # the last place of each value but the largest
        at = at[(at + 1 >= LEAVES_MIN) & (len(v) - at - 1 >= LEAVES_MIN)]
        if len(at):
            gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - whole
            top = int(gain.argmax())
            if gain[top] > best[0] + 1e-9:
                best = (float(gain[top]), k, float(v[at[top]]))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _grow(x[left], g[left], h[left], depth - 1), _grow(x[~left], g[~left], h[~left], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def _tree_sql(tree) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"if(f[{tree[0]}] <= {tree[1]!r}D, {_tree_sql(tree[2])}, {_tree_sql(tree[3])})"


def candidates(frame: DataFrame) -> DataFrame:
    """The frame with `cand`: all proposed spans of column text, with their generator."""
    every = ", ".join(f"transform({_found('g_' + n, p)}, s -> struct(s.start as start, s.end as end, s.m as m, '{n}' as g))" for n, p in GENERATORS.items())
    return frame.withColumn("cand", F.expr(f"concat({every})"))


#: SQL: the kind of a candidate.
_KIND = f"case when s.g in ('address', 'spelled') then 'email' when s.g = 'account' then 'account' when s.g = 'national' then 'national' when s.g = 'card' or char_length({_DIGITS}) >= 14 then 'card' when s.m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then 'ip' else 'phone' end"
_models: dict[tuple[int, int], tuple[str, dict[str, float]]] = {}


def model(spark: SparkSession, n: int = 3000, seed: int = 7) -> tuple[str, dict[str, float]]:
    """SQL of the trees' sum over features `f`, and for each kind the threshold on it at which held-out precision is PRECISION."""
    if (n, seed) not in _models:
        made = [(a, *core.split("|", 1), z) for a, core, z in examples(n, seed)]
        rows = [{"no": k, "personal": int(kind != ""), "begin": len(a), "stop": len(a) + len(core), "text": a + core + z} for k, (a, kind, core, z) in enumerate(made)]
        frame = spark.sql("select inline(from_json(:j, 'array<struct<no:int,personal:int,begin:int,stop:int,text:string>>'))", args={"j": json.dumps(rows)})
        each = candidates(frame).select("no", "personal", "begin", "stop", "text", F.explode("cand").alias("s"))
        got = each.select("no", F.expr("if(personal = 1 and s.start = begin and s.end = stop, 1, 0) as right"), F.expr(f"{_features()} as f"), F.expr(f"{_KIND} as kind")).collect()
        got.sort(key=lambda r: (r["no"], r["kind"], r["f"]))
        x, y = np.array([r["f"] for r in got]), np.array([r["right"] for r in got], float)
        kinds = np.array([r["kind"] for r in got])
        hold = np.array([r["no"] % 3 == 0 for r in got])
        score = np.zeros(len(y))
        trees = []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            trees.append(_grow(x[~hold], (p - y)[~hold], (p * (1 - p))[~hold], DEPTH))
            score += _value(trees[-1], x)
        least = {}
        for kind in (*KINDS, *MORE_KINDS):
            of = hold & (kinds == kind)
            order = np.argsort(-score[of], kind="stable")
            precision = np.cumsum(y[of][order]) / np.arange(1, of.sum() + 1)
            good = np.flatnonzero(precision >= PRECISION)
            least[kind] = max(0.0, float(score[of][order][good[-1]])) if len(good) else 1e9
        _models[n, seed] = " + ".join(map(_tree_sql, trees)), least
    return _models[n, seed]


def _spanned(found: DataFrame) -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, rank, end, kind), sorted."""
    trees, least = model(found.sparkSession)
    typed = "array<struct<start:int,rank:int,end:int,kind:string>>"
    each = ", ".join(f"transform(filter({_found(k, PATTERNS[k])}, s -> {VALID[k]}), s -> struct(s.start as start, {i} as rank, s.end as end, '{k}' as kind))" for i, k in enumerate(KINDS))
    based = candidates(found.withColumn("base", F.expr(f"cast(array_sort(concat({each})) as {typed})")))
    item = "struct<start:int,end:int,score:double,kind:string>"
    scored = f"transform(cand, s -> named_struct('start', s.start, 'end', s.end, 'score', aggregate(array({_features()}), 0D, (a, f) -> a + {trees}), 'kind', {_KIND}))"
    enough = "case s.kind " + " ".join(f"when '{k}' then {v!r}D" for k, v in least.items()) + " end"
    over = f"filter({scored}, s -> s.score >= {enough})"
    # one sweep from left to right: of overlapping candidates the one of the highest score stays, and none that overlaps a base span
    fixed = "transform(base, s -> named_struct('start', s.start, 'end', s.end, 'score', 1e300D, 'kind', s.kind))"
    push = "if(a.cur is null or a.cur.score = 1e300D, a.out, array_append(a.out, a.cur))"
    joined = "named_struct('start', a.cur.start, 'end', greatest(a.cur.end, s.end), 'score', a.cur.score, 'kind', a.cur.kind)"
    step = (
        f"case when a.cur is null or s.start >= a.cur.end then named_struct('out', {push}, 'cur', s) when s.score > a.cur.score then named_struct('out', a.out, 'cur', s) "
        f"when s.score = 1e300D then named_struct('out', a.out, 'cur', {joined}) else a end"
    )
    swept = f"aggregate(cast(array_sort(concat({fixed}, {over})) as array<{item}>), named_struct('out', cast(array() as array<{item}>), 'cur', cast(null as {item})), (a, s) -> {step}, a -> {push})"
    ranks = "array(" + ", ".join(f"'{k}'" for k in (*KINDS, *MORE_KINDS)) + ")"
    added = f"transform({swept}, s -> named_struct('start', s.start, 'rank', cast(array_position({ranks}, s.kind) - 1 as int), 'end', s.end, 'kind', s.kind))"
    more = F.expr(f"case when size(cand) = 0 then base else array_sort(concat(base, cast({added} as {typed}))) end")
    return based.select("doc_id", "text", "base", more.alias("spans"))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every document."""
    return _spanned(id_and_text(docs)).select("doc_id", "base", "spans")


def _joined(name: str) -> str:
    return f"array_join(transform({name}, s -> concat_ws(':', s.kind, cast(s.start as string), cast(s.end as string))), ',')"


def digests(docs: DataFrame) -> DataFrame:
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint) as n_{k}") for k in KINDS]
    return spans(docs).select("doc_id", *counts, F.expr(f"sha2({_joined('base')}, 256) as base_sha256"), F.expr(f"{_joined('spans')} as spans"), F.expr("cast(size(spans) as bigint) as n_spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; of overlapping spans the first is replaced."""
    cut = "aggregate(spans, struct(0 as at, '' as out), (a, s) -> if(s.start < a.at, a, struct(s.end as at, a.out || substring(text, a.at + 1, s.start - a.at) || '[' || upper(s.kind) || ']' as out)), a -> a.out || substring(text, a.at + 1))"
    return _spanned(id_and_text(docs)).select("doc_id", F.expr(cut).alias("text"))
