"""Text normalisation, tokens, hashes and similarity as Column expressions."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..rules import lexicon as L

# ASCII word boundaries: Java's own ``\b`` also counts accented letters as word characters.
_START = r"(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])"
_END = r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"


def ascii_words(pattern: str) -> str:
    """Replace a leading ``\b`` by a word start and every later one by a word end."""
    flags, rest = (pattern[:4], pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    if rest.startswith(r"\b"):
        rest = _START + rest[2:]
    return flags + rest.replace(r"\b", _END)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@functools.lru_cache(maxsize=1)
def _accent_map() -> tuple[str, str]:
    """Characters whose decomposition is one base plus marks, then the marks themselves."""
    marks = [chr(c) for c in range(0x300, 0x370)]
    src, dst = [], []
    for code in range(0xC0, 0x10000):
        if 0x300 <= code < 0x370 or 0xD800 <= code < 0xE000:
            continue
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if c not in marks)
        if len(base) == 1 and base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src + marks), "".join(dst)


def deaccent(c) -> Column:
    return F.translate(col(c), *_accent_map())


def normalize_text(c) -> Column:
    plain = F.regexp_replace(deaccent(F.lower(col(c))), r"[^\p{L}\p{N}\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def norm(c) -> Column:
    """ASCII form used by the fact rules: a-z, 0-9 and single blanks."""
    return F.trim(F.regexp_replace(deaccent(F.lower(col(c))), r"[^a-z0-9]+", " "))


def words(normalized) -> Column:
    return F.filter(F.split(col(normalized), " "), lambda w: w != "")


def tokenize(c) -> Column:
    """Distinct tokens of three or more characters, first occurrence order, no stop words."""
    stop = F.array(*[F.lit(w) for w in sorted(set(L.STOPWORDS))])
    kept = F.filter(F.split(normalize_text(c), " "), lambda w: F.char_length(w) >= 3)
    return F.array_except(F.array_distinct(kept), stop)


def sha256(c) -> Column:
    return F.sha2(col(c), 256)


def content_hash(title, body, first: int | None = None) -> Column:
    """Hash of the distinct tokens of a text; of the ``first`` ones only, if asked for."""
    tokens = tokenize(F.concat_ws(" ", col(title), col(title), col(body)))
    return hash_tokens(tokens, first)


def hash_tokens(tokens, first: int | None = None) -> Column:
    return F.sha2(F.array_join(F.slice(col(tokens), 1, first) if first else col(tokens), " "), 256)


def fnv1a(c) -> Column:
    """32-bit FNV-1a over the UTF-16 units of a string."""
    def mixed(h, unit):
        return (h.bitwiseXOR(unit) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))

    def step(h, ch):
        code = F.ascii(ch).cast("long")
        over = code - 0x10000
        two = mixed(mixed(h, F.shiftright(over, 10) + 0xD800), over.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        return F.when(code < 0x10000, mixed(h, code)).otherwise(two)

    return F.aggregate(F.filter(F.split(col(c), ""), lambda ch: ch != ""), F.lit(2166136261).cast("long"), step)


def _fnv_spans(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """FNV-1a of many spans of one code array, one character position at a time."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    h = np.full(len(starts), 2166136261, dtype=np.uint64)
    alive = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
    for pos, n in enumerate(alive):
        h[:n] = ((h[:n] ^ codes[starts[:n] + pos]) * np.uint64(16777619)) & np.uint64(0xFFFFFFFF)
    out = np.empty_like(h)
    out[order] = h
    return out


# Bit b >= 32 is the lowest bit of FNV(shingle + "#" + b). The multiplier is odd, so the
# lowest bit only xors with the lowest bits of the appended characters: it equals the
# lowest bit of FNV(shingle), flipped or not. 32 vote counts are therefore enough.
_FLIPPED = np.array([1 ^ (ord(str(b)[0]) & 1) ^ (ord(str(b)[1]) & 1) for b in range(32, 64)], dtype=bool)


#: Shingles that are hashed together; a longer text is voted on slice by slice.
SHINGLES = 1 << 18


def _token_units(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All tokens joined by "_" as UTF-16 units, and the units of each token."""
    codes = np.frombuffer("_".join(tokens.to_pylist()).encode("utf-16-le"), np.uint16).astype(np.uint64)
    sizes = pc.utf8_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    if sizes.sum() + max(len(tokens) - 1, 0) != len(codes):  # characters of two units
        sizes = np.array([len(t.encode("utf-16-le")) // 2 for t in tokens.to_pylist()], np.int64)
    return codes, sizes


def _simhashes(tokens: pa.ListArray, most: int) -> list[str]:
    """SimHash of every token list of a batch, taken up in pieces of about ``most`` tokens: memory does not follow the batch."""
    ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
    out, at = [], 0
    while at < len(tokens):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out += _simhashes_of(tokens.slice(at, to - at), most)
        at = to
    return out


def _simhashes_of(tokens: pa.ListArray, most: int) -> list[str]:
    """SimHash of these token lists: shingles of all of them are hashed and voted on in slices of ``most``."""
    tokens = tokens.cast(pa.list_(pa.string()))
    bounds = np.asarray(tokens.offsets) - tokens.offsets[0].as_py()
    n = np.diff(bounds)
    codes, sizes = _token_units(tokens.flatten())
    begin = np.cumsum(sizes + 1) - sizes - 1
    end = begin + sizes
    row = np.repeat(np.arange(len(n)), n)
    place, left = np.arange(len(row)) - bounds[row], n[row] - 1 - (np.arange(len(row)) - bounds[row])
    ones, count = np.zeros((len(n), 32), np.int64), np.zeros(len(n), np.int64)
    # A shingle starts at each token and ends one or two tokens on; a single token is one by itself.
    for step, some in ((0, (left == 0) & (place == 0)), (1, left >= 1), (2, left >= 2)):
        at = np.flatnonzero(some)
        for lo in range(0, len(at), most):
            part = at[lo:lo + most]
            h = _fnv_spans(codes, begin[part], end[part + step] - begin[part])
            own = row[part]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for b in range(32):
                ones[own[first], b] += np.add.reduceat((h >> np.uint64(b) & np.uint64(1)).astype(np.int64), first)
            count[own[first]] += np.diff(np.append(first, len(own)))
    votes = 2 * ones - count[:, None]
    votes = np.concatenate((votes, np.where(_FLIPPED, -votes[:, :1], votes[:, :1])), axis=1)
    return [x.hex() for x in np.packbits(votes > 0, axis=1).reshape(len(n), 8).view("V8").ravel().tolist()] if len(n) else []


def simhash_tokens(tokens) -> Column:
    """SimHash-64 of a token array: 2- and 3-token shingles, hex digits, first bit leading; null like no tokens."""
    most = SHINGLES

    @F.arrow_udf(StringType())
    def hashed(tokens: pa.Array) -> pa.Array:
        return pa.array(_simhashes(tokens, most), pa.string())

    return hashed(F.coalesce(col(tokens), F.array().cast("array<string>")))


def simhash(c) -> Column:
    return simhash_tokens(tokenize(c))


def _half(hex16: Column, start: int) -> Column:
    return F.conv(F.substring(hex16, start, 8), 16, 10).cast("long")


def hamming(a, b) -> Column:
    a, b = col(a), col(b)
    bits = sum(F.bit_count(_half(a, s).bitwiseXOR(_half(b, s))) for s in (1, 9))
    ok = a.rlike("^[0-9a-f]{16}$") & b.rlike("^[0-9a-f]{16}$")
    return F.when(ok, bits).otherwise(F.lit(64)).cast("int")


def simhash_similarity(a, b) -> Column:
    return F.lit(1.0) - hamming(a, b) / F.lit(64.0)


def jaccard(a, b) -> Column:
    """Share of common tokens; 0 when either side is empty. Both arrays hold distinct tokens."""
    a, b = col(a), col(b)
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / union).otherwise(F.lit(0.0))


def cosine(a, b) -> Column:
    a, b = col(a), col(b)

    def dot(x, y):
        return F.aggregate(
            F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norms > 0)
    return F.when(ok, dot(a, b) / norms).otherwise(F.lit(0.0))


def parse_embedding(c) -> Column:
    values = F.filter(
        F.from_json(col(c), "array<double>"),
        lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.size(values) > 0, values)


def decode_entities(c) -> Column:
    """Numeric character references, then the named ones (any letter case)."""
    return _decode_named(_decode_numeric(col(c)))


def bind(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(c), fn), F.lit(0))


def _decode_numeric(c: Column) -> Column:
    # Leading zeros do not count; what is longer than that lies beyond the last character and stays as it is.
    for pattern, base in ((r"(?i)&#x0*([0-9a-f]{1,6});", 16), (r"&#0*(\d{1,7});", 10)):
        def decode(text):
            codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
            gaps = F.split(text, pattern)

            def one(code, i):
                n = F.conv(code, base, 10).cast("long")
                char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
                return F.when(n < 0x110000, char).otherwise(F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), i))

            tail = F.zip_with(F.transform(codes, one), F.slice(gaps, 2, F.greatest(F.size(codes), F.lit(1))),
                              lambda ch, gap: F.concat(ch, gap))
            whole = F.concat(F.get(gaps, F.lit(0)), F.array_join(tail, ""))
            return F.when(text.rlike(pattern), whole).otherwise(text)

        c = bind(c, decode)
    return c


def _decode_named(c: Column) -> Column:
    # "&" itself is decoded last so that a decoded ampersand never starts a second entity.
    names = [n for n in L.ENTITIES if n != "amp"] + ["amp"]
    for name in names:
        c = F.regexp_replace(c, f"(?i)&{name};", F.lit(L.ENTITIES[name]))
    return c


def strip_markup(c) -> Column:
    c = col(c)
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</(?:p|div|h[1-6]|li|tr)>", "\n\n")
    return F.regexp_replace(c, r"<[^>]+>", " ")


def _squeeze(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def trim_all(c) -> Column:
    return F.regexp_replace(col(c), r"^[\s ]+|[\s ]+$", "")


def html_to_text(c) -> Column:
    return trim_all(_squeeze(decode_entities(strip_markup(c))))


def tidy(c) -> Column:
    c = F.regexp_replace(F.regexp_replace(col(c), "\r\n", "\n"), r"[ \t]+", " ")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def truncate(c, limit: int) -> Column:
    """Cut at the last blank when it lies beyond 60 % of the limit, and mark the cut."""
    c = col(c)
    cut = F.substring(c, 1, limit)
    back = F.instr(F.reverse(cut), " ")
    last = F.when(back > 0, F.lit(limit) - back).otherwise(F.lit(-1))
    kept = F.when(last > limit * 0.6, F.substring(cut, F.lit(1), last)).otherwise(cut)
    cut_mark = F.concat(F.regexp_replace(kept, r"\s+$", ""), F.lit("…"))
    return F.when(F.char_length(c) <= limit, c).otherwise(cut_mark)


def slugify(c) -> Column:
    dashed = F.regexp_replace(F.lower(deaccent(c)), r"[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, r"^-+|-+$", ""), 1, 90)


def word_count(c) -> Column:
    return F.size(F.filter(F.split(col(c), r"\s+"), lambda w: w != ""))


def ngrams(tokens, n: int = 6) -> Column:
    tokens = col(tokens)
    grams = F.transform(
        F.sequence(F.lit(1), F.size(tokens) - F.lit(n - 1)),
        lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))


def copy_overlap(original, rewritten, n: int = 6) -> Column:
    """Share of the original's n-gram positions that also occur in the rewrite.

    Both arguments are token-array columns (``words(normalize_text(...))``) computed beforehand.
    """
    orig = ngrams(original, n)
    rew = F.array_distinct(ngrams(rewritten, n))
    shared = F.size(F.filter(orig, lambda g: F.array_contains(rew, g)))
    return F.when((F.size(orig) > 0) & (F.size(rew) > 0), shared / F.size(orig)).otherwise(F.lit(0.0))


_FINDINGS = "array<struct<type:string,original:string,replacement:string>>"


def redact_pii(c) -> Column:
    """struct(clean, findings): rules in order, each on the text the rules before it left.

    A rule is one step of nested one-element transforms, so every intermediate text is built once.
    Text without three digits in a row or an ``@`` cannot match any rule and passes untouched.
    """
    none = F.expr(f"cast(array() as {_FINDINGS})")
    start = F.struct(col(c).alias("clean"), none.alias("findings"))
    state = start
    for kind, pattern, mark in L.PII_RULES:
        pattern = ascii_words(pattern)

        def rule(p):
            hits = F.transform(F.regexp_extract_all(p["clean"], F.lit(pattern), F.lit(0)), lambda m: F.struct(
                F.lit(kind).alias("type"), m.alias("original"), F.lit(mark).alias("replacement")))
            return F.struct(F.regexp_replace(p["clean"], pattern, mark).alias("clean"),
                            F.concat(p["findings"], hits).alias("findings"))

        state = F.get(F.transform(F.array(state), rule), F.lit(0))
    return F.when(col(c).rlike("[0-9]{3}|@"), state).otherwise(start)


def findings_summary(findings) -> Column:
    """Counts per type as one sentence, or null without findings."""
    kinds = F.array_distinct(F.transform(col(findings), lambda f: f["type"]))
    parts = F.transform(kinds, lambda k: F.concat(
        F.lower(k), F.lit(": "), F.size(F.filter(col(findings), lambda f: f["type"] == k)).cast("string")))
    return F.when(F.size(kinds) > 0, F.concat(
        F.lit("Datos personales eliminados automaticamente ("), F.array_join(parts, ", "), F.lit(").")))


def significant_numbers(c) -> Column:
    """1-3 digit numbers that state victims, judged on 28 characters before and 34 from the number on.

    Number offsets come from the running length of the split pieces, so it stays in the JVM.
    """
    text = col(c)
    pat = ascii_words(r"\b(\d{1,3})\b")
    nums = F.regexp_extract_all(text, F.lit(pat), F.lit(0))
    gaps = F.split(text, pat)
    # Offset (1-based) of number i = lengths of gaps[0..i] and numbers[0..i-1], plus one.
    pos = F.transform(nums, lambda n, i: F.aggregate(
        F.slice(gaps, 1, i + 1), F.lit(1), lambda s, g: s + F.char_length(g))
        + F.aggregate(F.slice(nums, 1, i), F.lit(0), lambda s, g: s + F.char_length(g)))
    judged = F.transform(F.arrays_zip(nums.alias("n"), pos.alias("p")), lambda e: F.struct(
        e["n"].cast("int").alias("n"),
        F.lower(F.substring(text, F.greatest(F.lit(1), e["p"] - 28), F.least(F.lit(28), e["p"] - 1))).alias("b"),
        F.lower(F.substring(text, e["p"], F.lit(34))).alias("a")))
    keep = F.filter(judged, lambda e: F.when(
        e["a"].rlike(ascii_words(L.VICTIM_AFTER)) | e["b"].rlike(ascii_words(L.VICTIM_BEFORE)), True)
        .when(e["b"].rlike(ascii_words(L.REF_BEFORE)) | e["a"].rlike(ascii_words(L.REF_AFTER)), False)
        .when(F.concat(e["b"], F.lit(" "), e["a"]).rlike(ascii_words(L.CALENDAR)), False)
        .otherwise(e["n"] >= 10))
    return F.sort_array(F.array_distinct(F.transform(keep, lambda e: e["n"])), asc=False)


def lost_numbers(original, rewritten) -> Column:
    """Significant numbers of the original missing from the rewrite, as digits or in words."""
    plain = deaccent(rewritten)
    spelled = F.create_map(*[F.lit(v) for kv in L.SPELLED.items() for v in kv])
    low = F.concat(F.lit(" "), F.regexp_replace(F.lower(plain), r"[^a-z0-9_]+", " "), F.lit(" "))
    return F.filter(significant_numbers(original), lambda n: ~(
        plain.contains(n.cast("string"))
        | F.coalesce(low.contains(F.concat(F.lit(" "), F.try_element_at(spelled, n), F.lit(" "))), F.lit(False))))
