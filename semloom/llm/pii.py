"""Personal data: base patterns of the contract, and bootstrapped contextual extraction of further identifiers.

Method. Base matches are seed instances. The token left of an instance is a lexical pattern of its kind;
all identifier-shaped strings of the corpus, seeds or not, are instances of the pattern they stand after.
Spark scores this pattern-instance graph for a few rounds: a pattern is as good as the share of its
occurrences that lead to trusted instances, an unseen instance as good as its best pattern. Patterns of
high confidence that at least ``support`` different seeds induced then label unseen instances.

Scale. Texts are read once. Only strings with the shape of identifiers leave the scan; the graph is
aggregated per (pattern, instance) before it moves, and all rounds are grouped sums and equi-joins.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, per_text, read_table

KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order of spans that start together: base kinds as the contract lists them, then the method's.
SPAN_KINDS = (*KINDS, "ctx_email", "ctx_ip", "ctx_card", "ctx_phone")
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.6, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a run of digits that fails from its start fails from within
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
#: Shapes of unseen identifiers: looser than the base patterns, so that context decides. A mailbox name has 64 characters
#: and a label of a domain 63 at most, as in the standards; a number has 7 to 25 digits. A pattern is a token of up to 24 characters.
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[\[(]at[\])] ?|@)[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63})*")
_LOOSE_NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9(](?:[\x20().\-/]{0,2}[0-9]){6,24}(?![A-Za-z0-9])")
LEFT_LENGTH = 24
_LEFT = re.compile(rf"(\S{{1,{LEFT_LENGTH}}})[ \t]{{0,2}}[\"'(]?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, per kind from left to right."""
    if not _ANY.search(text):
        return []
    spans = [(s, 0, e) for s, e in _emails(text)]
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(spans)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-shaped strings that overlap no base match; a string may have the shape of more than one kind."""
    found = [(m.start(), 0, m.end()) for m in _LOOSE_MAIL.finditer(text)] if "@" in text or "at]" in text or "at)" in text else []
    for m in _LOOSE_NUMBER.finditer(text):
        digits = sum(map(str.isdigit, m[0]))
        if m[0].count(".") == 3 and not set(m[0]) & set(" ()-/"):
            found.append((m.start(), 1, m.end()))
        else:
            found += [(m.start(), 2, m.end())] * (12 <= digits <= 19) + [(m.start(), 3, m.end())] * (7 <= digits <= 15)
    return [x for x in found if not any(x[0] < e and s < x[2] for s, _, e in base)]


def left_token(text: str, start: int) -> str | None:
    m = _LEFT.search(text[max(0, start - 40) : start])
    return m[1].lower() if m else None


def token_counts(low: str, wanted: set[str]) -> dict[str, int]:
    """How often each of the given left tokens stands in a text in lower case: as a token or as the start of one that goes on with another kind of character.

    A left token of full length may be the end of a longer one, so it counts wherever it stands.
    """
    counts = dict.fromkeys(wanted, 0)
    sizes = sorted({len(x) for x in wanted if len(x) < LEFT_LENGTH})
    long = any(len(x) == LEFT_LENGTH for x in wanted)
    word = lambda c: c.isalnum() or c == "_"
    for token, n in Counter(low.split()).items():
        whole = lambda at: at >= len(token) or not (word(token[at - 1]) and word(token[at]))  # noqa: B023, E731
        for size in sizes:
            if size > len(token):
                break
            if token[:size] in counts and whole(size):
                counts[token[:size]] += n
        for at in range(LEFT_LENGTH, len(token) + 1) if long else ():
            if token[at - LEFT_LENGTH : at] in counts and whole(at):
                counts[token[at - LEFT_LENGTH : at]] += n
    return counts


def join_spans(spans) -> str:
    return ",".join(f"{SPAN_KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(texts):
    import hashlib

    for text in texts:
        base = base_spans(text)
        loose = loose_spans(text, base) if base or _ANY.search(text) or "at]" in text or "at)" in text else []
        occ = []
        for seed, spans in ((True, base), (False, loose)):
            for s, k, e in spans:
                if (left := left_token(text, s)) is not None:
                    occ.append({"kind": k, "seed": seed, "left": left, "instance": text[s:e] if e - s <= 64 else hashlib.md5(text[s:e].encode()).hexdigest(), "start": s, "end": e, "around": 0})
        # how often a pattern stands in the text, once for each kind: at its first occurrence
        own = Counter((o["kind"], o["left"]) for o in occ)
        counts = token_counts(text.lower(), {o["left"] for o in occ}) if occ else {}
        for o in occ:
            if m := own.pop((o["kind"], o["left"]), 0):
                o["around"] = max(m, counts[o["left"]])
        n = [sum(k == j for _, k, _ in base) for j in range(4)]
        key = hashlib.md5(text.encode()).hexdigest() if any(not o["seed"] for o in occ) else None
        yield (*n, hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base), key, occ or None)


_OCC = "occ array<struct<kind int, seed boolean, left string, instance string, start int, end int, around int>>"


def confident_patterns(edges: DataFrame, rounds: int = ROUNDS, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """``(kind, left)`` of the patterns of high confidence, from ``edges(kind, left, instance, seed, n, around)``."""
    trust = edges.select("kind", "instance", "seed").groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    for _ in range(rounds):
        scored = edges.join(trust, ["kind", "instance"]).groupBy("kind", "left").agg(
            (F.sum(F.col("trust") * F.col("n")) / F.greatest(F.sum("n"), F.sum("around"))).alias("score"),
            F.sum(F.col("seed").cast("int")).alias("seeds"),
        )
        scored = materialize(scored, "pii-patterns")
        best = edges.join(scored, ["kind", "left"]).groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("seed"), F.max(F.when(F.col("seeds") >= support, F.col("score"))).alias("best"))
        trust = best.select("kind", "instance", F.greatest("seed", F.coalesce("best", F.lit(0.0))).alias("trust"))
    return scored.filter((F.col("score") >= confidence) & (F.col("seeds") >= support)).select("kind", "left")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base matches, the digest of base spans and all spans, for each row of ``docs(doc_id, text)``.

    ``spans`` lists kind:start:end in code points, by start and then kind; kinds of spans that context
    found begin with ``ctx_``, and ``n_spans`` counts them all. Null and empty texts have no spans. Texts are scanned whole, however long;
    repeated rows give equal rows (their spans come from the text alone); a null doc_id is kept. An
    empty table gives an empty one; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = f"n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, key string, {_OCC}"
    scanned = materialize(per_text(docs, ["doc_id"], schema, _scan), "pii-scan")
    occ = scanned.filter("occ is not null").select("key", F.inline("occ"))
    edges = occ.groupBy("kind", "left", "instance").agg(F.max("seed").alias("seed"), F.count(F.lit(1)).alias("n"), F.sum("around").alias("around"))
    patterns = confident_patterns(materialize(edges, "pii-edges"))
    found = occ.filter("not seed").join(patterns, ["kind", "left"]).select("key", "start", (F.col("kind") + 4).alias("k"), "end").distinct()
    found = found.groupBy("key").agg(F.collect_list(F.struct("start", "k", "end")).alias("found"))

    names = F.array(*[F.lit(k) for k in SPAN_KINDS])
    parsed = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("int").alias("start"), F.array_position(names, F.split(x, ":")[0]).cast("int").alias("k"), F.split(x, ":")[2].cast("int").alias("end")))
    own = F.transform("found", lambda x: F.struct(x["start"].alias("start"), (x["k"] + 1).cast("int").alias("k"), x["end"].alias("end")))
    merged = F.transform(F.array_sort(F.concat(parsed, own)), lambda x: F.concat_ws(":", F.element_at(names, x["k"]), x["start"].cast("string"), x["end"].cast("string")))
    out = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    plain = scanned.filter("key is null").select(*out, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_context"))
    joined = scanned.filter("key is not null").join(found, "key", "left")
    rest = joined.select(*out, F.when(F.col("found").isNull(), F.col("base")).otherwise(F.array_join(merged, ",")).alias("spans"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_context"))
    both = plain.unionByName(rest)
    return both.withColumn("n_spans", F.col("n_email") + F.col("n_ip") + F.col("n_card") + F.col("n_phone") + F.col("n_context"))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read_table(spark, sf_dir, "documents"))
