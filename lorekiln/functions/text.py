"""Text functions. All but the ones under 'Unicode' stay inside the JVM."""

from __future__ import annotations

import hashlib
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

# A maximal run of letters and digits is a word; Han characters are these ranges.
WORD = r"[\p{IsAlphabetic}\p{N}]+"
HAN = r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
# Ranges of characters that count as wide when tokens are estimated.
WIDE = r"\u1100-\u115F\u2E80-\u303E\u3041-\u33FF\u3400-\u4DBF\u4E00-\u9FFF\uA000-\uA4CF\uAC00-\uD7A3\uF900-\uFAFF\uFE30-\uFE4F\uFF00-\uFF60\uFFE0-\uFFE6"
#: Characters up to here have no other composed form, and these are their own compatibility forms.
_BEFORE_MARKS = r"\A[\x00-\u02FF]*\z"
_OWN_FORM = r"\A[\x00-\x9F\xA1-\xA7\xA9\xAB-\xAE\xB0\xB1\xB6\xB7\xBB\xBF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E]*\z"


def _accents() -> tuple[str, str]:
    """Lower-case letters up to U+1FFF that decompose, and the letters that they begin with."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and c.isalpha() and c == c.lower() and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, FOLDED = _accents()


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: Column) -> Column:
    """Without white space of any kind at its ends."""
    return F.regexp_replace(text, r"\A\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")


def collapsed(text: Column) -> Column:
    """Trimmed, and each run of white space of any kind one space."""
    return F.regexp_replace(trimmed(text), r"\p{IsWhite_Space}+", " ")


def tokens(text: Column | str, fold: bool = False) -> Column:
    """Lower-case words of the NFKC form in order; each run of Han characters c1 c2 c3 gives c1, c1c2, c2, c2c3, c3.

    With ``fold``, letters lose their diacritics, as a full-text index sees them.
    """
    lower = F.lower(nfkc(text))
    clean = folded(lower) if fold else lower
    plain = F.regexp_extract_all(clean, F.lit(WORD), F.lit(0))
    word = F.regexp_extract_all(clean, F.lit(f"[{HAN}]+|[\\p{{IsAlphabetic}}\\p{{N}}&&[^{HAN}]]+"), F.lit(0))

    def pieces(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.when(i < F.length(w), F.array(F.substr(w, i, F.lit(1)), F.substr(w, i, F.lit(2)))).otherwise(F.array(F.substr(w, i, F.lit(1)))))
        return F.when(w.rlike(f"^[{HAN}]"), F.flatten(each)).otherwise(F.array(w))

    return F.when(clean.rlike(f"[{HAN}]"), F.flatten(F.transform(word, pieces))).otherwise(plain)


def folded(text: Column | str) -> Column:
    """Lower case without diacritics, as the full-text index sees words."""
    lower = F.lower(_col(text))
    # texts of single bytes have no diacritics, and most are such
    return F.when(F.octet_length(lower) == F.char_length(lower), lower).otherwise(F.translate(lower, ACCENTED, FOLDED))


def query_terms(text: Column | str, fold: bool = False) -> Column:
    """Distinct words of a query in the order of their first appearance."""
    return F.array_distinct(tokens(text, fold))


def match_expression(text: Column | str) -> Column:
    """The words of a query, quoted and joined by OR."""
    return F.array_join(F.transform(query_terms(text), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def estimate_tokens(text: Column | str) -> Column:
    """Two tokens for three wide characters, one for four others, each rounded up; an empty text counts one."""
    x = _col(text)
    wide = F.regexp_count(x, F.lit(f"[{WIDE}]"))
    narrow = F.length(x) - wide
    return (F.ceil(2 * wide / 3) + F.ceil(narrow / 4) + F.when(F.length(x) == 0, 1).otherwise(0)).cast("long")


def slug(text: Column | str) -> Column:
    """Runs of other characters than lower-case letters and digits, in NFC, become one hyphen; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfc(text)), r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")


def canonical_key(name: Column | str) -> Column:
    """NFKC, lower case, trimmed."""
    return trimmed(F.lower(nfkc(name)))


def label(name: Column | str, key: Column | str) -> Column:
    """A name, or its key where the name is empty (not where it is blank)."""
    return F.coalesce(F.nullif(_col(name), F.lit("")), _col(key))


def label_unless_blank(name: Column | str, key: Column | str) -> Column:
    return F.when(F.trim(F.coalesce(_col(name), F.lit(""))) != "", _col(name)).otherwise(_col(key))


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the NFC form after white space at line ends and around the whole text is gone."""
    lines = F.regexp_replace(nfc(text), r"[\p{IsWhite_Space}&&[^\n]]+(?=\n|\z)", "")
    return F.sha2(trimmed(lines), 256)


def claim_key(statement: Column | str) -> Column:
    """SHA-256, taken twice, of the statement in NFC with white space collapsed."""
    return F.sha2(F.sha2(collapsed(nfc(statement)), 256), 256)


def normalized_title(title: Column | str) -> Column:
    """NFKC, white space collapsed, lower case."""
    return F.lower(collapsed(nfkc(title)))


def top_directory(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", 1)


# Parts of file names that name a language, and ranges of characters that count as Chinese or Japanese.
SUFFIXES = {".zh-cn.": "zh-CN", ".zh_cn.": "zh-CN", ".cn.": "zh-CN", ".zh.": "zh-CN", ".en.": "en"}
CJK = r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\u3040-\u30FF"


def language(text: Column | str, frontmatter: Column | None = None, path: Column | None = None) -> Column:
    """Language tag: frontmatter, else a part of the file name, else by script.

    A tag's first part is in lower case, its second in upper case, further ones go. By script, of the first 4,096 characters: under
    16 letters (ASCII ones and those of CJK) 'und'; CJK over a twentieth of these 'zh'; else 'en'.
    """
    head = F.substring(_col(text), 1, 4096)
    cjk = F.regexp_count(head, F.lit(f"[{CJK}]"))
    letters = F.regexp_count(head, F.lit("[A-Za-z]")) + cjk
    script = F.when(letters < 16, "und").when(cjk * 20 > letters, "zh").otherwise("en")
    first: list[Column] = []
    if frontmatter is not None:
        parts = F.split(F.nullif(trimmed(frontmatter), F.lit("")), "-")
        first.append(F.when(F.size(parts) > 1, F.concat(F.lower(parts[0]), F.lit("-"), F.upper(F.get(parts, 1)))).otherwise(F.lower(parts[0])))
    if path is not None:
        name = F.lower(F.substring_index(path, "/", -1))
        first.append(F.coalesce(*[F.when(F.contains(name, F.lit(needle)), tag) for needle, tag in SUFFIXES.items()]))
    return F.coalesce(*first, script)


def section_text(title: Column, headings: Column, body: Column) -> Column:
    """Title, heading path and body of a section, a line each for the first two."""
    return F.concat_ws("\n", title, F.array_join(headings, " > "), body)


def excerpt(body: Column | str, most: int = 240) -> Column:
    """Up to the first blank line, at most ``most`` UTF-8 bytes cut at a character, trimmed."""
    first = F.substring_index(_col(body), "\n\n", 1)
    return F.trim(_cut_bytes(first, most))


def _cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters with at most ``most`` bytes; most texts need no search for it."""
    head = F.substring(text, 1, most)
    fits = F.filter(F.sequence(F.lit(most // 4), F.length(head)), lambda n: F.octet_length(F.substr(head, F.lit(1), n)) <= most)
    return F.when(F.octet_length(head) <= most, head).otherwise(F.substr(head, F.lit(1), F.array_max(fits)))


def chunk_text(title: Column, headings: Column, sources: Column, snippet: Column) -> Column:
    return F.concat_ws(" | ", title, F.array_join(headings, " > "), F.array_join(sources, ","), snippet)


def yaml_scalar(value: Column | str) -> Column:
    """Quoted where plain YAML would read it otherwise."""
    x = _col(value)
    plain = x.rlike(r"^[\p{L}\p{N}_./][\p{L}\p{N}_./ -]*$") & ~F.lower(x).isin("true", "false", "null", "yes", "no") & ~x.rlike(r"^[0-9.]+$") & ~x.rlike(" $")
    return F.when(plain, x).otherwise(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))


def frontmatter(**fields: Column) -> Column:
    """A block between lines of three hyphens, one scalar a line."""
    lines = [F.concat(F.lit(f"{name}: "), yaml_scalar(value)) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def page_file_name(slug_: Column, page_id: Column) -> Column:
    """A slug of ASCII letters, digits, - and _ as it is; else up to 48 such characters of it and eight hex digits of its SHA-256.

    Where no such character is left, the page's id serves.
    """
    squeezed = F.regexp_replace(slug_, "(?<=-)[^A-Za-z0-9_-]+", "")  # a dash that is there already serves for what follows
    safe = F.regexp_replace(squeezed, "[^A-Za-z0-9_-]+", "-")
    edge = lambda x: F.regexp_replace(x, r"\A-+|-+\z", "")
    prefix = edge(F.substring(edge(safe), 1, 48))
    named = F.when(prefix == "", page_id).otherwise(F.concat(prefix, F.lit("-"), F.substring(F.sha2(slug_, 256), 1, 8)))
    return F.concat(F.when(slug_.rlike(r"\A[A-Za-z0-9_-]+\z"), slug_).otherwise(named), F.lit(".md"))


def one_line_summary(text: Column | str, most: int = 600) -> Column:
    joined = F.regexp_replace(_col(text), r"\s*\n\s*", " ")
    return F.substring(F.trim(F.regexp_replace(joined, r"^[#\-*>\s]+", "")), 1, most)


def short_label(text: Column | str, most: int = 60) -> Column:
    return F.substring(_col(text), 1, most)


def redacted(text: Column | str) -> Column:
    """Bearer tokens, keys and absolute paths become placeholders."""
    x = F.regexp_replace(_col(text), r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    x = F.regexp_replace(x, r"(?i)\b(api[_-]?key|token|secret|password)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    x = F.regexp_replace(x, r"\bsk-[A-Za-z0-9_-]{8,}", "[redacted]")
    return F.regexp_replace(x, r"(?<![\w:/])/(?:[\w.-]+/)+[\w.-]+", "[path]")


# Citations and links inside page bodies -------------------------------------------------------

CITE = r'<!--\s*(?:[\w-]+:)?cite\s+claim="([^"]*)"\s*-->'
#: The same with or without a claim.
CITE_ANY = r"<!--\s*(?:[\w-]+:)?cite(?:\s(?:(?!-->)[\s\S])*)?-->"
LINK = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"


def cited_claims(body: Column | str) -> Column:
    return F.regexp_extract_all(_col(body), F.lit(CITE), F.lit(1))


def without_citations(body: Column | str) -> Column:
    return F.regexp_replace(_col(body), CITE_ANY, "")


def link_targets(body: Column | str) -> Column:
    """Trimmed titles that [[title]] and [[title|shown]] name."""
    return F.transform(F.regexp_extract_all(_col(body), F.lit(LINK), F.lit(1)), lambda t: F.trim(t))


def without_links(body: Column | str) -> Column:
    """Links replaced by what they show."""
    return F.regexp_replace(F.regexp_replace(_col(body), r"\[\[[^\]|]+\|([^\]]*)\]\]", "$1"), r"\[\[([^\]|]+)\]\]", "$1")


# Keys of caches and fingerprints --------------------------------------------------------------


def key_of(*parts: Column) -> Column:
    """SHA-256 over parts joined by a unit separator, null as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def set_key(values: Column) -> Column:
    """SHA-256 over the sorted distinct members."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(values)), "\x1f"), 256)


# Unicode: needs Python ------------------------------------------------------------------------


def _normal(form: str):
    @F.pandas_udf(StringType())
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda s: None if s is None else unicodedata.normalize(form, s))

    return normal


def nfc(text: Column | str) -> Column:
    return _unless(_BEFORE_MARKS, _normal("NFC"), _col(text))


def nfkc(text: Column | str) -> Column:
    return _unless(_OWN_FORM, _normal("NFKC"), _col(text))


def _unless(stable: str, normal, x: Column) -> Column:
    """Rows that a normal form leaves as they are, by a pattern, are handed over as null and kept."""
    return F.coalesce(normal(F.when(~x.rlike(stable), x)), x)


def fold_with_offsets(text: str) -> tuple[str, list[tuple[int, int]]]:
    """Lower-case letters and digits of a text, each with the UTF-8 byte range that it comes from in the original."""
    out, ranges, at = [], [], 0
    for char in text:
        size = len(char.encode("utf-8", "surrogatepass"))
        for c in unicodedata.normalize("NFKC", char).lower():
            if c.isalnum():
                out.append(c)
                ranges.append((at, at + size))
        at += size
    return "".join(out), ranges


def locate(quote: str, cited: str, others: list[str]) -> tuple[int, int, int, str] | None:
    """Where a quote stands: number of the section (0 the cited one), byte range and SHA-256 of the original slice."""
    wanted, _ = fold_with_offsets(quote)
    if not wanted:
        return None
    for number, text in enumerate([cited, *others]):
        body, ranges = fold_with_offsets(text)
        found = body.find(wanted)
        if found >= 0:
            start, end = ranges[found][0], ranges[found + len(wanted) - 1][1]
            return number, start, end, hashlib.sha256(text.encode()[start:end]).hexdigest()
    return None


@F.pandas_udf(StructType([StructField("section", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("digest", StringType())]))
def locate_evidence(quote: pd.Series, cited: pd.Series, others: pd.Series) -> pd.DataFrame:
    rows = [locate(q or "", c or "", list(o) if o is not None else []) or (None, None, None, None) for q, c, o in zip(quote, cited, others, strict=True)]
    return pd.DataFrame(rows, columns=["section", "start", "end", "digest"]).astype({"section": "Int32", "start": "Int64", "end": "Int64"})


_WORDS = regex.compile(r"[\p{Alphabetic}\p{N}]+")
_HAN = regex.compile(f"([{HAN}]+)")
_FOLDS = str.maketrans(ACCENTED, FOLDED)


def words_of(text: str, fold: bool = False) -> list[str]:
    """``tokens`` of one text, in Python."""
    out: list[str] = []
    clean = unicodedata.normalize("NFKC", text).lower()
    for word in _WORDS.findall(clean.translate(_FOLDS) if fold else clean):
        for piece in filter(None, _HAN.split(word)):
            if _HAN.match(piece):
                for i, c in enumerate(piece):
                    out += [c, piece[i : i + 2]] if i + 1 < len(piece) else [c]
            else:
                out.append(piece)
    return out


@F.pandas_udf(StringType())
def _snippet(bodies: pd.Series, queries: pd.Series) -> pd.Series:
    def one(body: str, query: str) -> str:
        w, wanted, size = words_of(body or ""), set(words_of(query or "")), 16
        hits = [x in wanted for x in w]
        best = max(range(max(1, len(w) - size + 1)), key=lambda i: (len({x for x, h in zip(w[i : i + size], hits[i : i + size], strict=True) if h}), -i), default=0)
        shown = [f"[{x}]" if h else x for x, h in zip(w[best : best + size], hits[best : best + size], strict=True)]
        return (" … " if best else "") + " ".join(shown) + (" … " if best + size < len(w) else "")

    return pd.Series([one(b, q) for b, q in zip(bodies, queries, strict=True)])


def snippet(body: Column | str, query: Column) -> Column:
    """Sixteen words around most of a query's words, which stand in brackets; of the tokenised text, as an index keeps it."""
    return _snippet(_col(body), query)
