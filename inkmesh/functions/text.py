"""Names, lengths and orders of strings.

Names are compared by their *handle* (trimmed, lower-cased, NFC). Lengths and
orders count UTF-16 units, as the data model asks; Spark counts code points and
orders by UTF-8 bytes, so both are spelled out here.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What counts as white space at the ends of a name.
WHITE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
TITLE_BYTES = 200
SLUG_LIMIT = 60
_SPACE = re.compile(f"[{WHITE}]+")
_FORBIDDEN = re.compile(r'[\[\]#^|\\/:?*"<>\x00-\x1f]')


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends (``F.trim`` takes U+0020 alone)."""
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def trim_py(s: str) -> str:
    return re.sub(rf"\A[{WHITE}]+|[{WHITE}]+\Z", "", s)


def handle_py(name: str) -> str:
    return unicodedata.normalize("NFC", trim_py(name).lower())


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def handle(c: Column, nfc: bool = True) -> Column:
    """The spelling that names share. ``nfc=False`` stays in the JVM, for text known to be NFC."""
    plain = F.lower(trim(c))
    return nfc_of(plain) if nfc else plain


def nfc_of(c: Column) -> Column:
    """NFC. Only text with characters from U+0300 on may be other than that already, so only such goes to Python."""
    return F.coalesce(_nfc(F.when(c.rlike("[^\\u0000-\\u02ff]"), c)), c)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("long")


def utf16_order(c: Column) -> Column:
    """A sort key in order of UTF-16 units."""
    return F.encode(c, "UTF-16BE")


def path_key(path: str) -> bytes:
    """The same for a string."""
    return path.encode("utf-16-be", "surrogatepass")


def token_estimate(c: Column) -> Column:
    """A token for each four UTF-16 units, rounded up."""
    return F.ceil(F.octet_length(F.encode(c, "UTF-16BE")) / F.lit(8)).cast("long")


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s*[\r\n]+\s*", " "))


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; none for dotfiles."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def infrastructure(path: Column) -> Column:
    return basename(path).startswith("_")


def is_under(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def folders_above(path: Column) -> Column:
    """All that a path lies in, from the top of the vault (the empty string) to its own folder, which comes last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def unrepresentable(path: Column) -> Column:
    """A path that a link could not name: line ends, a backslash, or white space at an end."""
    return path.rlike(r"[\n\r\u2028\u2029\\]") | (trim(path) != path)


def normalize_path_py(path: str) -> str:
    out: list[str] = []
    for part in path.replace("\\", "/").split("/"):
        if part in ("", "."):
            continue
        if part == "..":
            if out:
                out.pop()
        else:
            out.append(part)
    return "/".join(out)


def sanitize_title(c: Column, nfc: bool = True) -> Column:
    """A title a file can bear."""
    t = F.regexp_replace(nfc_of(c) if nfc else c, r'[\[\]#^|\\/:?*"<>\x00-\x1f]', "")
    t = F.regexp_replace(t, f"[{WHITE}]+", " ")
    t = F.regexp_replace(t, r"^[_. ]+", "")
    t = F.regexp_replace(trim(t), r"[. ]+$", "")
    return F.when(t == "", "Untitled").otherwise(t)


def sanitize_title_py(title: str) -> str:
    t = _SPACE.sub(" ", _FORBIDDEN.sub("", unicodedata.normalize("NFC", title)))
    t = trim_py(t.lstrip("_. ")).rstrip(". ")
    return t or "Untitled"


def fnv1a(s: str) -> int:
    """FNV-1a over UTF-16 units, 32 bits."""
    raw, h = s.encode("utf-16-le", "surrogatepass"), 0x811C9DC5
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return h


def base36(n: int, width: int = 7) -> str:
    out = ""
    while n:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
    return out.rjust(width, "0")


def _within(title: str, limit: int) -> str:
    raw = title.encode("utf-8", "surrogatepass")
    return title if len(raw) <= limit else raw[:limit].decode("utf-8", "ignore")


def bound_title_py(title: str, limit: int = TITLE_BYTES) -> str:
    """Within so many UTF-8 bytes; a cut title carries a tag of its whole handle."""
    if _within(title, limit) == title:
        return title
    tag = "-" + base36(fnv1a(handle_py(title)))
    return (_within(title, limit - len(tag)).rstrip(". ") or "Untitled") + tag


def title_stem_py(title: str) -> str:
    return bound_title_py(sanitize_title_py(title))


@F.pandas_udf(StringType())
def title_stem(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else title_stem_py(x))


def unique_title_py(title: str, taken: set[str]) -> str:
    """``title``, or with the first free of -2, -3, ...; ``taken`` holds handles."""
    own = bound_title_py(title)
    n = 2
    while handle_py(own) in taken:
        own = bound_title_py(title, TITLE_BYTES - len(f"-{n}")) + f"-{n}"
        n += 1
    return own


def slug(c: Column, nfc: bool = True) -> Column:
    t = F.regexp_replace(F.lower(nfc_of(c) if nfc else c), "[^a-z0-9]+", "-")
    t = F.regexp_replace(t, "^-+|-+$", "")
    t = F.regexp_replace(F.substring(t, 1, SLUG_LIMIT), "-+$", "")
    return F.when(t == "", "answer").otherwise(t)


def slug_py(text: str) -> str:
    t = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFC", text).lower()).strip("-")
    return t[:SLUG_LIMIT].rstrip("-") or "answer"


def cell(c: Column) -> Column:
    """A value inside a Markdown table."""
    return F.replace(one_line(c), F.lit("|"), F.lit("\\|"))


def longest_run_py(text: str, char: str = "`") -> int:
    return max((len(m) for m in re.findall(f"{re.escape(char)}+", text)), default=0)


#: Fixed value: what stands where a text was cut.
MARKER = "<!-- truncated for context budget -->"


def truncate_tail_py(text: str, tokens: int, marker: str = MARKER) -> str:
    """Cut to a token budget, the marker included; no surrogate pair is split."""
    units = text.encode("utf-16-le", "surrogatepass")
    if len(units) // 2 <= tokens * 4:
        return text
    ending = "\n" + marker
    room = tokens * 4 - len(ending.encode("utf-16-le")) // 2
    if room <= 0:
        return marker
    if 0xD800 <= int.from_bytes(units[2 * room - 2 : 2 * room], "little") < 0xDC00:
        room -= 1
    return re.sub(rf"[{WHITE}]+\Z", "", units[: 2 * room].decode("utf-16-le", "surrogatepass")) + ending


@F.pandas_udf(StringType())
def truncate_tail(text: pd.Series, tokens: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else truncate_tail_py(t, int(n)) for t, n in zip(text, tokens, strict=True)], dtype=object)
