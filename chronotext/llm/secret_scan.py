"""Secret scans: fixed patterns, and strings that a primed zstandard cannot compress.

The compressor's dictionary holds common identifiers; a candidate's novelty is
the growth of the compressed surroundings when the candidate is put back into
them. Candidates stand shortly after a sensitive word, and one that costs almost
as much as random strings of its own alphabet and length do there is reported.
"""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, tidied, to_batches

# The base patterns and their least lengths, in the order of the kinds.
ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more, whole: shorter runs never match
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"(?ai:secret|token|passw(?:or)?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|"
                       r"credential|bearer|authorization|signature)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}(?:\.[A-Za-z0-9+/_=-]{16,})*")  # with the dots between parts of a web token
REACH = 64  # characters after a sensitive word in which a candidate begins
CONTEXT = 256  # characters on either side that the candidate is measured against
LEAST = 16  # characters of a candidate
NOVELTY = 0.85  # of the mean growth that random strings of the candidate's alphabet and length make in its place
NOVELTY_OF_LETTERS = 0.92  # the same for strings without a digit, which may be names made of words
DRAWS = 12  # such strings
LETTERS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "_-", "=")
MASK = "<SECRET>"
#: Letters as frequent as in words and identifiers, in front of every context: literals are then always
#: entropy-coded, so that a common letter costs less than a rare one in short and long contexts alike.
PRIMER = "".join(random.Random(0).choices(
    "etaoinshrdlcumwfgypbvkxjqz" + "ETAOINSHRDLCUMWFGYPBVKXJQZ" + "0123456789" + " _-/+=.",
    [*(120, 90, 80, 75, 70, 70, 63, 60, 60, 43, 40, 28, 28, 24, 23, 22, 20, 20, 19, 15, 10, 8, 3, 2, 2, 2),
     *(24, 18, 16, 15, 14, 14, 13, 12, 12, 9, 8, 6, 6, 5, 5, 4, 4, 4, 4, 3, 2, 2, 1, 1, 1, 1),
     *(20, 18, 14, 8, 8, 8, 8, 8, 8, 8), 60, 24, 24, 18, 2, 4, 14], k=2000))

IDENTIFIERS = " ".join("""
abstract access account action address admin algorithm allow api application args array assert async auth authorization
await base64 bearer begin bool boolean bucket buffer build byte cache callback catch certificate char class client
cluster code column command commit config connection const constructor container content context continue cookie
credential data database date debug default delete dict document domain double element email enable encoding encrypt
endpoint environment error event example except export extends false field file filter final finally float folder
format from function generate get global group handle hash header host http https id identifier implements import
include index init input instance int integer interface internal item iterator json key lambda length library list
load local localhost log login long map message method model module name namespace network new node none null number
object option output package page parameter params parse passphrase password path pattern payload permission port
print private process project property protected protocol public query queue random raise read record region request
response result return role root row save schema script secret select self server service session set setting
signature source span static status storage stream string struct super switch system table task test text thread
throw time timestamp token true try type uint update upload url user username utf value variable version virtual
void while width window with write yaml yield
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef placeholder changeme
xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 your_api_key_here your-secret-token example_key
""".split())


class Scanner:
    """Finds the spans ``(start, end, kind number)`` of one text after another."""

    def __init__(self, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY):
        self.compressor = zstandard.ZstdCompressor(
            level=3, dict_data=zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False)
        self.novelty = novelty
        self.primer = PRIMER + identifiers[:800]  # the identifiers, so that matches have been coded before as well
        self.drawn: dict[tuple[str, int], list[str]] = {}

    def base(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        if ":" in text or "=" in text:
            found += [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(*m.span(), 1) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
        found += [(*m.span(), 2) for m in HEX.finditer(text)]
        return sorted(found, key=lambda s: (s[0], s[2]))

    def marginal_bytes(self, before: str, body: str, after: str) -> int:
        around = (self.primer + before + after).encode()
        return len(self.compressor.compress(around + body.encode())) - len(self.compressor.compress(around))

    def is_novel(self, text: str, start: int, end: int) -> bool:
        body = text[start:end]
        before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
        plain = body.rstrip("=")
        usual = [self.marginal_bytes(before, x + body[len(plain):], after) for x in self.random_strings(alphabet(plain), len(plain))]
        least = self.novelty if any(c.isdigit() for c in plain) else max(self.novelty, NOVELTY_OF_LETTERS)
        return self.marginal_bytes(before, body, after) * len(usual) >= least * sum(usual)

    def random_strings(self, letters: str, n: int) -> list[str]:
        """The same strings for the same alphabet and length in every task."""
        if (letters, n) not in self.drawn:
            rng = random.Random(f"{letters},{n}")
            found = ["".join(rng.choices(letters, k=n)) for _ in range(DRAWS)]
            if n > 1024 or len(self.drawn) > 5000:
                return found
            self.drawn[letters, n] = found
        return self.drawn[letters, n]

    def novel(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Strings shortly after a sensitive word, not inside a base span, that are as costly as random ones."""
        words = SENSITIVE.finditer(text)
        word = next(words, None)
        if word is None:
            return []
        found, last, k = [], None, 0
        for m in CANDIDATE.finditer(text):
            start, end = m.span()
            while word is not None and word.end() <= start:
                last, word = word.end(), next(words, None)
            while word is not None and end - word.end() >= LEAST:  # in the string itself, which begins behind it then
                last = start = word.end()
                word = next(words, None)
            while k < len(base) and base[k][1] <= start:
                k += 1
            if last is None or start - last > REACH or k < len(base) and base[k][0] < end:
                continue
            if self.is_novel(text, start, end):
                found.append((start, end, 3))
        return found

    def scan(self, text: str | None) -> tuple[list, list]:
        """Base spans, and all spans, both by start and then kind."""
        if not text:
            return [], []
        base = self.base(text)
        return base, sorted(base + self.novel(text, base), key=lambda s: (s[0], s[2]))


def alphabet(body: str) -> str:
    """The groups of characters that ``body`` draws from; hexadecimal letters alone are a group of their own."""
    found = [g for g in LETTERS if any(c in g for c in body)]
    for low, high in (("abcdef", LETTERS[2]), ("ABCDEF", LETTERS[4])):
        if high in found and low not in found:
            found.append(low)
    return "".join(sorted(found))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every union of overlapping spans replaced by one mask."""
    out, at, end = [], 0, -1
    for s, e, _ in sorted(spans):
        if s >= end:
            out += [text[max(at, 0):s], MASK]
        end = max(end, e)
        at = end
    return "".join(out) + text[at:]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans)`` for every row.

    A span is the whole match, in code points, end exclusive. Null and empty
    texts have no spans; repeated rows and null ids keep their rows; other
    columns are not read; an empty table gives an empty table. Map-only.
    """
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS),
                        ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        scanner = Scanner(novelty=novelty)

        def rows():
            for b in batches:
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    base, spans = scanner.scan(text)
                    kinds = [s[2] for s in spans]
                    yield (key, *(kinds.count(k) for k in range(4)),
                           hashlib.sha256(written(base).encode()).hexdigest(), written(spans))
        with tidied():
            yield from to_batches(rows(), schema)

    return src.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, "
                               "base_sha256 string, spans string")


def mask_secrets(df: DataFrame, text_col: str = "text", length_col: str | None = None,
                 novelty: float = NOVELTY) -> DataFrame:
    """``df`` with all secrets in ``text_col`` masked, and ``length_col`` set to the new length where given.

    Every row stays, repeated ones and null ids too; a text without secrets is
    unchanged, and null stays null; other columns, whatever their names, stay as
    they are; an empty table gives an empty table. Map-only.
    """
    ship_package(df.sparkSession)

    def run(batches):
        scanner = Scanner(novelty=novelty)
        for b in batches:
            texts, changed = b.column(text_col).to_pylist(), {}
            for i, text in enumerate(texts):
                spans = scanner.scan(text)[1]
                if spans:
                    changed[i] = texts[i] = masked(text, spans)
            if changed:
                at = b.schema.get_field_index(text_col)
                b = b.set_column(at, b.schema.field(at), pa.array(texts, type=b.schema.field(at).type))
                if length_col is not None:
                    at = b.schema.get_field_index(length_col)
                    sizes = b.column(at).to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    b = b.set_column(at, b.schema.field(at), pa.array(sizes, type=b.schema.field(at).type))
            yield b

    return df.mapInArrow(run, df.schema)
