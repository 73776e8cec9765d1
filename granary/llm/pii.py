"""Personal data: base patterns, and further spans by weak supervision.

Base kinds (email, ip, card, phone) are found by pattern and check. Everything looser
(obfuscated addresses, local phone numbers, social security numbers, account numbers,
credentials, titled names) is a candidate. Three labelers vote on each candidate: its
pattern, a gazetteer, and the words before it. Votes of all candidates of all documents
are counted by pattern, a table of bounded size; expectation-maximisation on these
counts estimates how reliable each labeler is and how likely each pattern is personal
data, and a logistic span classifier over shape and votes is trained on that. The
classifier is then compiled into one expression.

Documents are seen by DataFrame functions only: no user function runs on them. Spans
are code points, end exclusive. Candidates are looked for where base spans are masked
by characters of equal number, so they never overlap.

Defined results: a null text is empty and has no spans; rows are judged one by one, so
repeated rows get equal spans; an empty table gives an empty result and a classifier
that accepts nothing; a text of any length is searched whole; ``redacted`` passes other
columns through, whatever their names, and ``n_chars`` follows a text that changed.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column, fresh, let

_LOCAL = r"[A-Za-z0-9._%+-]"
#: Base patterns. Quantifiers are possessive and starts guarded, which changes no match but makes long texts linear.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BEFORE = 24

TITLES = "Mr Mrs Ms Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
NAMES = "james mary john patricia robert jennifer michael linda david maria anna peter hans klaus jean pierre marie juan carlos jose luis ana carmen smith johnson garcia martin müller schmidt".split()
DOMAINS = "com org net edu gov io de fr es uk us info".split()
KEYS = "sk- ghp_ gho_ xox AKIA eyJ".split()
TRIGGERS = "token secret passw key auth login phone tel call mobile fax mail contact card visa account iban ssn social konto karte telefon tarjeta clave teléfono carte compte".split()
AGAINST = "order invoice isbn issn version page commit sha md5 build serial article doi".split()

_OBFUSCATED = rf"{_LOCAL}++\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\[dot\]|\(dot\)|\.)\x20?[A-Za-z0-9-]++)++"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL_PHONE = r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{3,4}(?![0-9])"
_PERSON = rf"(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}[\p{{L}}]++"
_TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
_NUMBER = r"[0-9]{9,19}+"
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])(?:{_PERSON}|{_SSN}|{_LOCAL_PHONE}|{_OBFUSCATED}|{_TOKEN}|{_NUMBER})"
#: Further kinds in the order in which they are told.
KINDS = ("address", "name", "number", "secret", "ssn", "telephone")
LABELERS = ("v_pattern", "v_gazetteer", "v_context")
FEATURES = ("kind", "size", "digits", *LABELERS)

#: Stand for the characters of base spans: code points that are not characters.
_MASKS = {"email": "\ufdd0", "ip": "\ufdd1", "card": "\ufdd2", "phone": "\ufdd3"}
_SPAN = "array<struct<a:bigint,b:bigint,m:string,before:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _count(m: Column, low: int, high: int) -> Column:
    return F.length(_digits(m)).between(low, high)


def _luhn(m: Column) -> Column:
    return _count(m, 13, 19) & F.call_function("luhn_check", _digits(m))


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")),
    "card": _luhn,
    "phone": lambda m: _count(m, 9, 15),
}
#: What a text must hold for a pattern to be looked for.
_NEEDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: t.contains("+"),
}


def running(x: Column) -> Column:
    """Running sums of an array of longs, in blocks of about the square root of its size."""
    add = lambda acc, v: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + v))
    sums = lambda a: F.aggregate(a, F.array().cast("array<bigint>"), add)

    def blocks(n: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / n).cast("int") - 1), lambda k: F.slice(x, k * n + 1, n))

        def whole(parts: Column) -> Column:
            before = lambda ends, k: F.coalesce(F.get(ends, k - 1), F.lit(0).cast("long"))
            ends = sums(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
            return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda v: v + before(e, k)))))

        return let(F.transform(cut, sums), whole)

    return F.when(F.size(x) <= 32, sums(x)).otherwise(let(F.ceil(F.sqrt(F.size(x))).cast("int"), blocks))


def found(text: Column, pattern: str, needs: Column | None = None) -> Column:
    """Array of (a, b, m, before) of the pattern's leftmost non-overlapping matches."""
    none = F.array().cast(_SPAN)
    size = lambda x: F.char_length(x).cast("long")

    def placed(m: Column) -> Column:
        def of(parts: Column) -> Column:
            steps = F.transform(m, lambda x, i: size(F.get(parts, i)) + size(x))
            row = lambda ends: lambda x, i: F.struct((F.get(ends, i) - size(x)).alias("a"), F.get(ends, i).alias("b"), x.alias("m"), F.right(F.get(parts, i), F.lit(_BEFORE)).alias("before"))
            return let(let(steps, running), lambda ends: F.transform(m, row(ends)))

        return F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), of))

    made = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return made if needs is None else F.when(needs, made).otherwise(none)


def base(text: Column) -> Column:
    """Struct of the spans of each base kind in a text."""
    fits = lambda k: lambda s: VALID[k](s["m"])
    return F.struct(*(F.filter(found(text, PATTERNS[k], _NEEDS[k](text)), fits(k)).alias(k) for k in PATTERNS))


def replaced(text: Column, pattern: str, by: Callable[[Column], Column]) -> Column:
    """``text`` with ``by(match)`` for each match."""
    join = lambda m: F.array_join(F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.coalesce(by(F.get(m, i)), F.lit("")))), "")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, text).otherwise(join(m)))


def masked(text: Column, kinds: tuple[str, ...] = tuple(PATTERNS)) -> Column:
    """``text`` with each character of a base span replaced by the kind's mask."""
    if not kinds:
        return text
    k, rest = kinds[0], kinds[1:]
    mask = lambda m: F.when(VALID[k](m), F.repeat(F.lit(_MASKS[k]), F.char_length(m))).otherwise(m)
    return let(F.when(_NEEDS[k](text), replaced(text, PATTERNS[k], mask)).otherwise(text), lambda t: masked(t, rest))


def covered(text: Column) -> Column:
    """``masked``, but where base spans of the text overlap their union is masked first, with the mask of the longest.

    A kind that is masked first would else cut another's span, and the rest of that would stay.
    """
    span = lambda k: lambda s: F.struct(s["a"].alias("a"), (-s["b"]).alias("z"), F.lit(_MASKS[k]).alias("c"), (s["b"] - s["a"]).alias("n"))
    spans = lambda b: F.array_sort(F.concat(*(F.transform(b[k], span(k)) for k in PATTERNS)))
    cut = lambda s: F.exists(F.sequence(F.lit(1), F.size(s) - 1), lambda i: F.get(s, i)["a"] < -F.get(s, i - 1)["z"])

    def join(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        longer = lambda f: F.when(s["n"] > last["n"], s[f]).otherwise(last[f]).alias(f)
        one = F.struct(last["a"].alias("a"), F.least(last["z"], s["z"]).alias("z"), longer("c"), longer("n"))
        return F.when((F.size(acc) > 0) & (s["a"] < -last["z"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(s)))

    def out(m: Column) -> Column:
        end = lambda i: F.coalesce(-F.get(m, i - 1)["z"], F.lit(0))
        part = lambda s, i: F.concat(F.substring(text, (end(i) + 1).cast("int"), (s["a"] - end(i)).cast("int")), F.repeat(s["c"], (-s["z"] - s["a"]).cast("int")))
        rest = F.substring(text, (end(F.size(m)) + 1).cast("int"), F.char_length(text))
        return F.concat(F.array_join(F.transform(m, part), ""), rest)

    none = F.array().cast("array<struct<a:bigint,z:bigint,c:string,n:bigint>>")
    union = let(let(base(text), spans), lambda s: F.when((F.size(s) > 1) & cut(s), let(F.aggregate(s, none, join), out)).otherwise(text))
    return let(union, lambda t: masked(t))


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def labelled(s: Column) -> Column:
    """A candidate's kind, shape and votes (1 for, -1 against, 0 none)."""
    m, before = s["m"], F.lower(s["before"])
    like = m.rlike
    kind = (
        F.when(like(rf"^(?:{'|'.join(TITLES)})\.?\x20"), "name").when(like(r"(?:\[at\]|\(at\))"), "address").when(like(rf"^{_SSN}$"), "ssn")
        .when(like(r"^[0-9]{9,}$"), "number").when(like(r"^\(?[0-9]{2,4}\)?[\x20.-]"), "telephone").otherwise("secret")
    )
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    no = F.lit(False)
    mixed = like("[a-z]") & like("[A-Z]") & like("[0-9]")
    n_digits = F.length(_digits(m))

    def of(k: Column) -> Column:
        pattern = (
            F.when(k == "ssn", vote(~like("^(?:000|666|9)|-00-|-0000$"), F.lit(True)))
            .when(k == "telephone", vote(like(r"^\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}$") | n_digits.between(10, 11), n_digits < 9))
            .when(k == "number", vote(_luhn(m), n_digits >= 13))
            .when(k == "secret", vote(like("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | mixed, ~like("[0-9]") | ~like("[A-Za-z]")))
            .when(k == "address", 1).otherwise(0)
        )
        gazetteer = (
            F.when(k == "secret", vote(like("^" + _any(KEYS)), like("/[a-z]+/[a-z]+|^[=_-]+$")))
            .when(k == "number", vote(like("^(?:4|5[1-5]|34|37|6011|65)"), like(r"^([0-9])\1+$")))
            .when(k == "address", vote(F.lower(m).rlike(_any(DOMAINS) + "$"), F.lit(True)))
            .when(k == "name", vote(F.lower(m).rlike(r"\x20" + _any(NAMES) + "$"), no)).otherwise(0)
        )
        context = vote(before.rlike(_any(TRIGGERS)), before.rlike(_any(AGAINST)))
        size = F.least(F.floor(F.log2(F.char_length(m).cast("double"))), F.lit(7)).cast("int")
        digits = F.floor(F.lit(3.0) * n_digits / F.char_length(m)).cast("int")
        return F.struct(
            s["a"].alias("a"), s["b"].alias("b"), k.alias("kind"), size.alias("size"), digits.alias("digits"),
            pattern.cast("int").alias("v_pattern"), gazetteer.cast("int").alias("v_gazetteer"), context.cast("int").alias("v_context"),
        )

    return let(kind, of)


def candidates(mask: Column) -> Column:
    """Labelled candidates of a masked text."""
    return F.transform(found(mask, CANDIDATE, _may_hold(mask)), labelled)


def _may_hold(mask: Column) -> Column:
    return mask.rlike(rf"[0-9]|[A-Za-z+/_=-]{{20}}|(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}")


@dataclass
class Model:
    """A logistic classifier of spans; what expectation-maximisation found is kept beside it."""

    weights: dict[tuple[str, object], float]
    bias: float
    reliability: dict[str, dict[int, tuple[float, float]]]

    def accepts(self, s: Column) -> Column:
        total = F.lit(float(self.bias))
        for f in FEATURES:
            own = [(v, w) for (name, v), w in sorted(self.weights.items(), key=str) if name == f and w]
            if own:
                of = F.create_map(*itertools.chain.from_iterable((F.lit(v), F.lit(float(w))) for v, w in own))
                total = total + F.coalesce(F.try_element_at(of, s[f]), F.lit(0.0))
        return total > 0


def expectation_maximisation(kinds: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """P(personal) of each row and P(vote | class) by (labeler, class, vote + 1), from counted vote patterns.

    Starts from the vote sums and holds each labeler by pseudo-counts to be better than chance.
    """
    prior_counts = np.tile(np.array([[[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]]]), (votes.shape[1], 1, 1))
    p = 1 / (1 + np.exp(-1.5 * votes.sum(1)))
    table = prior_counts
    for _ in range(rounds):
        both = np.stack([n * (1 - p), n * p])
        table = prior_counts.copy()
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                table[j, :, v + 1] += both[:, votes[:, j] == v].sum(1)
        table /= table.sum(2, keepdims=True)
        logit = np.zeros(len(n))
        for k in np.unique(kinds):
            own = kinds == k
            share = ((n * p)[own].sum() + 1) / (n[own].sum() + 2)
            logit[own] = np.log(share / (1 - share))
        for j in range(votes.shape[1]):
            logit += np.log(table[j, 1, votes[:, j] + 1] / table[j, 0, votes[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done, p = np.abs(new - p).max() < 1e-9, new
        if done:
            break
    return p, table


def train(counted: list[tuple]) -> Model:
    """A model from rows (kind, size, digits, votes..., n); sorted, so the order of rows doesn't matter."""
    if not counted:
        return Model({}, -1.0, {})
    rows = sorted(counted)
    n = np.array([r[-1] for r in rows], float)
    first = FEATURES.index(LABELERS[0])
    votes = np.array([r[first : first + len(LABELERS)] for r in rows], int)
    p, table = expectation_maximisation(np.array([r[0] for r in rows]), votes, n)
    names = sorted({(f, r[i]) for r in rows for i, f in enumerate(FEATURES)}, key=str)
    at = {x: i for i, x in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        for j, f in enumerate(FEATURES):
            x[i, at[f, r[j]]] = 1
    w, weight = np.zeros(len(names) + 1), n / n.max() * 1000 + 1e-3
    ridge = np.eye(len(w)) * 1e-2
    for _ in range(50):  # Newton steps of the ridge-penalised logistic loss with soft labels
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (weight * q * (1 - q) + 1e-9)) @ x + ridge, x.T @ (weight * (q - p)) + ridge @ w)
        w = w - step
        if np.abs(step).max() < 1e-10:
            break
    w = np.round(w, 9)
    told = {f: {v: (float(table[j, 0, v + 1]), float(table[j, 1, v + 1])) for v in (-1, 0, 1)} for j, f in enumerate(LABELERS)}
    return Model({k: float(w[i]) for k, i in at.items()}, float(w[-1]), told)


def counted(spans: DataFrame) -> list[tuple]:
    """Candidates (column cands) counted by kind, shape and votes: a few thousand rows at most, whatever the corpus."""
    each = spans.select(F.explode("cands").alias("s")).select(*(F.col(f"s.{f}").alias(f) for f in FEATURES))
    return [tuple(r) for r in each.groupBy(*FEATURES).count().collect()]


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def detected(docs: DataFrame) -> tuple[DataFrame, Model]:
    """doc_id, base (spans by kind) and extra (accepted candidates), and the model that accepted them."""
    scratch = Scratch(docs.sparkSession)
    plain = lambda b: F.struct(*(F.transform(b[k], lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias(k) for k in PATTERNS))
    some = lambda b: (F.size(b["email"]) + F.size(b["ip"]) + F.size(b["card"]) + F.size(b["phone"])) > 0
    cands = lambda b: F.when(some(b), let(masked(_text()), candidates)).otherwise(candidates(_text()))
    both = let(base(_text()), lambda b: F.struct(plain(b).alias("base"), cands(b).alias("cands")))
    spans = scratch.save(docs.select("doc_id", both.alias("s")).select("doc_id", "s.base", "s.cands"), "spans")
    model = train(counted(spans))
    return spans.select("doc_id", "base", F.filter("cands", model.accepts).alias("extra")), model


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256 and all spans, for every row of ``docs``."""
    found_, _ = detected(docs)
    told = lambda k, spans: F.transform(spans, lambda s: F.concat_ws(":", F.lit(k), s["a"].cast("string"), s["b"].cast("string")))
    bases = F.concat(*(told(k, F.col(f"base.{k}")) for k in PATTERNS))
    of_kind = lambda k: lambda s: s["kind"] == k
    extras = [told(k, F.filter("extra", of_kind(k))) for k in KINDS]
    return found_.select(
        "doc_id", *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(bases, ","), 256).alias("base_sha256"), F.array_join(F.concat(bases, *extras), ",").alias("spans"),
    )


def _parted(t: Column) -> Column:
    """Struct of what stands between the candidates of a text, and of the candidates with their texts."""
    none = F.array().cast("array<struct<m:string,s:struct<a:bigint,b:bigint,kind:string,size:int,digits:int,v_pattern:int,v_gazetteer:int,v_context:int>>>")
    here = lambda x, part: F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), x.alias("m"), F.right(part, F.lit(_BEFORE)).alias("before"))

    def of(m: Column) -> Column:
        items = lambda parts: F.transform(m, lambda x, i: F.struct(x.alias("m"), labelled(here(x, F.get(parts, i))).alias("s")))
        some = let(F.split(t, CANDIDATE, -1), lambda parts: F.struct(parts.alias("parts"), items(parts).alias("items")))
        return F.when(F.size(m) == 0, F.struct(F.array(t).alias("parts"), none.alias("items"))).otherwise(some)

    return let(F.when(_may_hold(t), F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")), of)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``[KIND]`` in place of every span; columns stay, whatever their names.

    Patterns run once over each text: the texts are written in parts with their
    candidates, from which the classifier is trained and the new texts are put together.
    """
    scratch = Scratch(docs.sparkSession)
    cut, new = fresh(docs, "cut_", "new_")
    own = [column(c) for c in docs.columns]
    made = let(_text(), lambda x: let(covered(x), lambda t: F.struct((t != x).alias("masked"), _parted(t).alias("of"))))
    others = [c for c, name in zip(own, docs.columns, strict=True) if name != "text"]
    held = scratch.save(docs.select(*others, F.when(F.col("text").isNotNull(), made).alias(cut)), "parts")
    of = F.col(cut)["of"]
    model = train(counted(held.select(F.transform(of["items"], lambda i: i["s"]).alias("cands"))))

    def label(item: Column) -> Column:
        return F.when(model.accepts(item["s"]), F.concat(F.lit("["), F.upper(item["s"]["kind"]), F.lit("]"))).otherwise(item["m"])

    text = F.array_join(F.transform(of["parts"], lambda p, i: F.concat(p, F.coalesce(label(F.get(of["items"], i)), F.lit("")))), "")
    whole = F.when(F.size(of["items"]) == 0, F.get(of["parts"], 0)).otherwise(text)
    marked = whole
    for k, c in _MASKS.items():
        marked = F.regexp_replace(marked, f"{c}+", f"[{k.upper()}]")
    changed = F.col(cut)["masked"] | F.exists(of["items"], lambda i: model.accepts(i["s"]))
    out = held.withColumn(new, F.when(F.col(cut)["masked"], marked).otherwise(whole))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.char_length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(new).alias("text") if name == "text" else c for c, name in zip(own, docs.columns, strict=True)))
