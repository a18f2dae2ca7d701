"""Personal data by bootstrapped contextual extraction [free style].

1. Seeds: e-mail addresses, IP addresses, payment cards and phone numbers that fixed patterns and their checks find in whole
   texts (leftmost, non-overlapping by kind; failing matches are dropped without retries).
2. Candidates: runs of one to three tokens with digits or an at sign that overlap no seed, longer runs beside a word with as
   many digits as a phone or card has, and the seeds themselves. Each one has lexical patterns: its shape (digits, letters,
   punctuation), the words before and after it with its coarse shape, and, for forms that no seed has, the words before and
   after it with the kinds whose number of digits or whose mark (at sign, address) it has.
3. Pattern-instance graph: Spark counts distinct (pattern, instance) edges. By rounds, a pattern's confidence in a kind is
   the mean score of its instances with one doubtful instance added, an instance's score the best confidence of its patterns
   that at least ``support`` distinct seeds induced. Seeds keep score 1.
4. Candidates whose score reaches ``accept`` and that pass their kind's checks (e.g. a card that a fixed pattern ran together
   with the phone number beside it, a phone without plus, an address with other letters, an IPv6 address) are added, best and
   longest first, where they overlap no base span and no addition of any kind.

Addresses may be of any length; runs of digits are at most WIDEST characters long, which no form of phone, card or IP address
exceeds. Neighbouring words are read whole.

Defined results: null text counts as empty; an empty text has no spans (digest of the empty string); texts are read whole in
linear time; repeated rows get equal rows; rows without id count like others; an empty table gives no rows; extra columns are
ignored, or kept by ``redact`` whatever their names; of equal scores the longer, then the earlier span wins, then the kind that
is listed first.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_text, rebuilt, stored, table

# fixed values: kinds in their order, character classes and bounds of the base patterns
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = re.compile(r"[+(]{0,3}[0-9](?:[\x20().-]{0,3}[0-9])*\)?")
WIDE = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'`#*$%&|<>[]{}"
#: A phone has up to 15 digits and at most three marks between two of them; cards and IP addresses are shorter.
WIDEST = 64
ROUNDS, SUPPORT, ACCEPT = 3, 5, 0.85
SPAN = "array<struct<start:int,end:int,surface:string,seed:int,patterns:array<string>>>"


def digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(number: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(number)):
        d = ord(ch) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def ipv6(s: str) -> bool:
    try:
        return ":" in s and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def valid(kind: int, s: str) -> bool:
    """The check of a kind on a string of its form; wider than the base patterns where a kind has other forms."""
    if kind == 0:
        return WIDE.fullmatch(s) is not None
    if kind == 1:
        return ipv6(s) or IP.fullmatch(s) is not None and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))
    d = digits(s)
    if kind == 2:
        return CARD.fullmatch(s) is not None and 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(s) <= WIDEST and LOOSE.fullmatch(s) is not None


def emails(text: str):
    """Spans of addresses: every one has an at sign with the longest local part to its left that no earlier one holds."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [(1, *m.span()) for m in IP.finditer(text) if valid(1, m[0])]
        out += [(2, *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def shape(s: str) -> str:
    """Digits as 9, lower-case letters as a, upper-case ones as A, others as they are; runs of letters shortened to one."""
    return re.sub(r"([aA])[aA]+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"[0-9]", "9", s)))


def coarse(s: str) -> str:
    return "".join(dict.fromkeys(shape(s)))


def forms(s: str) -> list[str]:
    """The kinds that a string may be of by its number of digits or its mark, whatever other characters it has."""
    if "@" in s:
        return ["email"]
    if valid(1, s):
        return ["ip"]
    n = len(digits(s))
    return ["phone"] * (9 <= n <= 15) + ["card"] * (13 <= n <= 19)


def words_beside(text: str, at: int, after: bool) -> list[str]:
    """The two words before or after a position, or what there is of them, whole and in lower case."""
    size = 40
    while True:
        part = text[at : at + size] if after else text[max(0, at - size) : at]
        words = part.split()
        if len(words) > 2 or len(part) < size:  # the outermost of three words may be cut
            return [w.lower() for w in (words[:2] if after else words[-2:])]
        size *= 4


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other runs of tokens with digits or an at sign, with their patterns. Runs of more than three tokens have 9 to 19
    digits and a word, not a number, on one side at least, so a list of numbers has few."""
    found: dict[tuple[int, int], int] = {(a, b): k for k, a, b in base}
    taken = sorted(found)
    tokens = []
    for m in re.finditer(r"[0-9@]", text):
        if tokens and m.start() < tokens[-1][1]:
            continue
        a = m.start()
        while a > 0 and text[a - 1] not in " \t\n\r\x0b\x0c":
            a -= 1
        tokens.append((a, TOKEN.match(text, a).end()))
    spans: dict[tuple[int, int], int] = dict(found)
    k = 0

    def beside(i: int) -> bool:
        """Whether only one blank parts a token from the next."""
        return 0 <= i < len(tokens) - 1 and tokens[i][1] + 1 == tokens[i + 1][0]

    for i in range(len(tokens)):
        for n in range(1, 20):  # no kind has more than 19 digits
            if i + n > len(tokens) or n > 1 and not beside(i + n - 2):
                break
            a, b = tokens[i][0], tokens[i + n - 1][1]
            if n > 3:
                size = len(digits(text[a : min(b, a + 200)]))
                if size > 19 or b - a > 200:  # wider than any form, blanks and marks at its ends included
                    break
                if size < 9 or beside(i - 1) and beside(i + n - 1):
                    continue
            while b > a and text[b - 1] in EDGE + ")" and not (text[b - 1] == ")" and "(" in text[a:b]):
                b -= 1
            while a < b and text[a] in EDGE:
                a += 1
            if b - a < 4 or b - a > WIDEST and (n > 1 or "@" not in text[a:b]):
                continue
            while k < len(taken) and taken[k][1] <= tokens[i][0]:
                k += 1
            j = k
            while j < len(taken) and taken[j][0] < b and taken[j][1] <= a:
                j += 1
            if j == len(taken) or taken[j][0] >= b:
                spans.setdefault((a, b), -1)
    out = []
    for (a, b), kind in sorted(spans.items()):
        s = text[a:b]
        left = ["^", *words_beside(text, a, False)]
        right = [*words_beside(text, b, True), "$"]
        c = coarse(s)
        patterns = [f"s {shape(s)}", f"l {left[-1]} {c}", f"r {right[0]} {c}"]
        for form in forms(s):
            patterns += [f"l1 {left[-1]} {form}"] * (len(left) > 1) + [f"l2 {' '.join(left[-2:])} {form}"] * (len(left) > 1) + [f"r2 {' '.join(right[:2])} {form}"] * (len(right) > 1)
        out.append({"start": a, "end": b, "surface": s, "seed": kind, "patterns": patterns})
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base spans, candidates) of every row; key tells rows of equal id and different text apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, cands = [], []
        for text in batch.column("text").to_pylist():
            found = seeds(text) if text and re.search("[0-9@]", text) else []
            base.append(joined(found))
            cands.append(candidates(text, found) if text and re.search("[0-9@]", text) else [])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("seed", pa.int32()), ("patterns", pa.list_(pa.string()))]))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(base, pa.string()), pa.array(cands, kind)], ["id", "key", "base", "cands"])

    return map_text(rows, "text", one, f"id long, key long, base string, cands {SPAN}")


def learn(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, accept: float = ACCEPT) -> DataFrame:
    """(surface, kind, score) of instances that high-confidence patterns discover, from rows with ``cands``."""
    c = found.select(F.explode("cands").alias("c")).select("c.*")
    edges = stored(c.select("surface", "seed", F.explode("patterns").alias("pattern")).groupBy("surface", "pattern").agg(F.max("seed").alias("seed")), "pii-edges")
    scores = edges.where("seed >= 0").select("surface", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    for _ in range(rounds):
        sums = edges.join(scores, "surface").groupBy("pattern", "kind").agg(F.sum("score").alias("total"), F.count(F.when(F.col("seed") == F.col("kind"), 1)).alias("seeds"))
        sizes = edges.groupBy("pattern").agg(F.count("*").alias("n"))
        good = sums.where(F.col("seeds") >= support).join(sizes, "pattern").select("pattern", "kind", (F.col("total") / (F.col("n") + 1)).alias("confidence")).where(F.col("confidence") >= accept)
        good = stored(good, "pii-patterns")
        new = edges.join(good, "pattern").groupBy("surface", "kind").agg(F.max("confidence").alias("score"), F.max("seed").alias("seed"))
        old = edges.where("seed >= 0").select("surface", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        scores = stored(new.where("seed < 0").select("surface", "kind", "score").union(old.distinct()).groupBy("surface", "kind").agg(F.max("score").alias("score")), "pii-scores")
    seen = edges.groupBy("surface").agg(F.max("seed").alias("seed"))
    return scores.where(F.col("score") < 1.0).join(seen.where("seed < 0").select("surface"), "surface", "left_semi")


def additions(found: DataFrame, **settings) -> DataFrame:
    """(key, more) with the candidates of each text that learning accepts; texts without any have no row."""
    known = learn(found, **settings)
    c = found.select("key", F.explode("cands").alias("c")).where("c.seed < 0").select("key", "c.start", "c.end", "c.surface")
    hits = c.join(known, "surface")
    return hits.groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end", "score", "surface")).alias("more"))


def resolve(base: str, more: list | None) -> tuple[list, list]:
    """Base spans and all spans: additions that pass their checks, best and longest first, where they overlap no span of their kind."""
    own = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in base.split(",") if x)]
    every = list(own)
    for m in sorted(more or [], key=lambda m: (-m["score"], m["start"] - m["end"], m["start"], m["kind"])):
        if valid(m["kind"], m["surface"]) and not any(m["start"] < b and a < m["end"] for _, a, b in every):
            every.append((m["kind"], m["start"], m["end"]))
    return own, sorted(every)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """(doc_id, key, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row; counts and digest are of base spans."""
    found = stored(scan(docs, id_col, text_col), "pii")
    more = stored(additions(found, **settings), "pii-additions")

    def finish(batches):
        for batch in batches:
            rows = [resolve(b, m) for b, m in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True)]
            counts = [pa.array([sum(k == i for k, _, _ in own) for own, _ in rows], pa.int64()) for i in range(len(KINDS))]
            sha = [hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in rows]
            names = ["doc_id", "key", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *counts, pa.array(sha, pa.string()), pa.array([joined(e) for _, e in rows], pa.string())], names)

    both = found.select("id", "key", "base").join(more, "key", "left").select("id", "key", "base", "more")
    return both.mapInArrow(finish, "doc_id long, key long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **settings) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; other columns stay."""
    spans = find(docs, id_col, text_col, **settings).where("spans <> ''").groupBy("key").agg(F.min("spans").alias("spans"))
    spans = stored(spans, "pii-spans")
    row, key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    marked = docs.select(row.alias("row"), key.alias("key")).join(spans.hint("merge"), "key", "left")

    def masked(texts: list, batch: pa.RecordBatch) -> list:
        return [t if t is None or not s else mask(t, s) for t, s in zip(texts, batch.column("spans").to_pylist(), strict=True)]

    return rebuilt(marked, [F.col("row")[c].alias(c) for c in docs.columns], text_col, {"spans": F.col("spans")}, masked)


def mask(text: str, spans: str) -> str:
    """A text with its spans replaced by their kinds in brackets; of overlapping ones the first gives the kind."""
    out, last = [], 0
    for a, b, k in sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(","))):
        if b > last:
            out += [text[last:a] if a > last else "", f"[{k.upper()}]"]
            last = b
    return "".join([*out, text[last:]])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("key")

