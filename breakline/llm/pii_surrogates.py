"""Personal data replaced by keyed surrogates of the same type.

Detected: e-mail addresses, IPv4 and IPv6 addresses, payment cards, IBANs, phone numbers (with a plus, brackets, a telling word before them or in groups
of three, three and four digits; not dates, versions or grouped thousands), US social security numbers, secrets (keys,
tokens, passwords after a telling word or with a known prefix, long hexadecimal strings), and names after a title or a telling
phrase, with all other mentions of them or of their parts in the same document. Each finding is replaced by the image of a keyed permutation of all strings of its format: letters stay letters of
their script and case, digits stay digits, punctuation stays, cards and IBANs keep valid check digits, a given name turns
into one of the same gender and script, another name keeps its last letter and has vowels and consonants where it had them. As a permutation has no collisions, different originals get different
surrogates and the same original the same surrogate everywhere, without any shuffle. Where formats could run into each other
(given names and other names, valid and invalid card numbers) an image that falls into the other class is permuted again until
it doesn't, which is again one to one. What is permuted is the spelling as found: leading zeros and case stay, so two spellings of
one address have two surrogates. ``collisions`` checks a whole corpus for two originals with one surrogate.

Defined results: null text stays null with 0 entities; a text without findings is returned as it is, byte for byte; repeated rows get
the same text; other columns are kept by ``replace_pii``, whatever their names (added columns get one more underscore where the caller has such a
name); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Apart, text_batches

KEY = b"surrogates-1"
_ROUNDS = 8

# Given names by script and gender; a surrogate is another name of the same list.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amelia Amina Anna Beatriz Carla Carmen Charlotte Clara Claire Elena Emma Eva Fatima Greta Hannah Heidi Ines Ingrid Isabel Jane Julia Katharina Laura Leila Lena Lucia Maria Marie Martha Mary Mei Mia Natalia Nina Olga Olivia Paula Priya Rosa Sarah Sofia Sophie Susan Svetlana Ursula Yuki Zeynep",
    ("latin", "m"): "Ahmed Alan Ali Andreas Antonio Arjun Bernd Bruno Carlos Charles David Diego Erik Ernst Fabian Felix Francois George Hans Henry Hiroshi Hugo Ivan Jack James Jean John Jorge Juan Karl Kenji Klaus Louis Luis Luca Marc Max Mehmet Miguel Mohammed Oliver Omar Oscar Otto Pablo Paul Pedro Peter Raj Rajesh Robert Sergei Thomas Wei Yusuf",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Алексей Андрей Борис Владимир Дмитрий Иван Игорь Максим Михаил Олег Павел Сергей",
    ("greek", "f"): "Αθηνά Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα",
    ("greek", "m"): "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σπύρος",
}
GIVEN = {k: v.split() for k, v in GIVEN.items()}
_GIVEN_AT = {n.lower(): (k, i) for k, names in GIVEN.items() for i, n in enumerate(names)}

_L = r"[^\W\d_]"
_NAME = rf"[A-ZÀ-ÖØ-ÞΆ-ΫА-ЯЁ]{_L}+(?:[-'’]{_L}+)*"
_FULL_NAME = rf"{_NAME}(?:[ ]{_NAME}){{0,3}}"

# Patterns of the detected kinds, first come first served.
_KINDS = [
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,})"),
    ("secret", r"(?i:\b(?:api[_ -]?key|access[_ -]?key|secret(?:[_ -]?key)?|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?)(?P<value>[A-Za-z0-9_/+=.-]{6,})"),
    ("secret", r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("ip6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ip6", r"(?<![\w:])(?=[0-9A-Fa-f:]*[0-9A-Fa-f])(?!(?:[0-9A-Fa-f]*:+){8})(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![\w:])"),
    ("card", r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9-])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+|00)[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,8}(?:[ .-][0-9]{2,8}){1,4}(?![\w-])|(?<![\w+])\+[0-9]{7,15}(?!\w)"),
    ("phone", r"(?<![\w.+-])(?:\([0-9]{2,5}\)[ .-]?[0-9]{2,8}(?:[ .-][0-9]{2,8}){0,4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})(?![\w-]|\.[0-9])"),
    ("phone", r"(?i:\b(?:tel|telephone|phone|call|fax|mobile|cell|telefon|telefax|handy|teléfono|móvil|téléphone|portable)\b[.:]{0,2}[ ]{0,2})(?P<cued>\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,8}){1,4}|[0-9]{7,15})(?![\w-]|\.[0-9])"),
    ("name", rf"(?:\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?[ ])(?P<name>{_FULL_NAME})"),
    ("name", rf"(?:\b(?:[Mm]y name is|[Ii]ch heiße|[Mm]e llamo|[Jj]e m'appelle|[Mm]ein Name ist|[Mm]i nombre es|[Mm]on nom est|Name:|Contact:)[ ]+)(?P<named>{_FULL_NAME})"),
]
_PATTERNS = [(kind, re.compile(p)) for kind, p in _KINDS]
#: A text without any of these has none of the kinds.
_HINT = re.compile(r"@|\d|::|[Kk][Ee][Yy]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]|[0-9a-fA-F]{32}|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b|name|Name|heiße|llamo|appelle|nom|Contact")


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all findings, none overlapping, in order."""
    if not _HINT.search(text):
        return []
    taken: list[tuple[int, int, str]] = []
    rest = text
    for kind, pattern in _PATTERNS:
        spans = []
        for m in pattern.finditer(rest):
            a, b = m.span(m.lastgroup) if m.lastgroup else m.span()
            if _holds(kind, text[a:b]):
                spans.append((a, b))
        if spans:  # what is found is hidden from the kinds that follow
            taken += [(a, b, kind) for a, b in spans]
            shown = zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(rest)], strict=True)
            rest = "".join(x for (a, b), hidden in zip(shown, [*(b - a for a, b in spans), 0], strict=True) for x in (rest[a:b], chr(0) * hidden))
    names = {text[a:b] for a, b, kind in taken if kind == "name"}
    names |= {part for name in names for part in [*name.split(" "), *re.split(r"[ \-'’]", name)] if len(part) > 1 and part[0].isupper()}
    if names:  # other mentions of the names and their parts, also in capitals
        said = sorted({x for n in names for x in (n, n.upper())}, key=lambda n: (-len(n), n))
        taken += [(*m.span(), "name") for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, said))})(?!\w)", rest)]
    return sorted(taken)


def _holds(kind: str, s: str) -> bool:
    """What a pattern alone can't tell: check digits, and the number of digits of a phone number."""
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in s) <= 15
    if kind == "iban":
        return _iban_ok(s)
    if kind == "card":  # long numbers are cards if they check, or have a card's length and first digits
        d = [int(c) for c in s if c.isdigit()]
        return _luhn(d[:-1]) == str(d[-1]) or re.match(r"(?:4|5[1-5]|2[2-7]|6)[0-9]{15}$|3[47][0-9]{13}$", "".join(map(str, d))) is not None
    return True


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class Keyed:
    """Keyed permutations of the strings of a format."""

    def __init__(self, key: bytes = KEY):
        self.key = key
        self.seen: dict[tuple[str, str], str] = {}

    def _number(self, tweak: str, round_no: int, value: int, size: int) -> int:
        said = f"{tweak}|{round_no}|{value}".encode()
        return int.from_bytes(hmac.new(self.key, said, hashlib.blake2b).digest()[:32], "big") % size

    def _walk(self, value: int, size: int, tweak: str, forth: bool) -> int:
        """An unbalanced Feistel network on a * b >= size, or its inverse, walked until the value is in range."""
        a = int(size**0.5) if size < 1 << 50 else 1 << (size.bit_length() // 2)
        b = -(-size // a)
        rounds = range(_ROUNDS) if forth else range(_ROUNDS - 1, -1, -1)
        while True:
            left, right = divmod(value, b)
            for r in rounds:
                if r % 2:
                    step = self._number(tweak, r, left, b)
                    right = (right + (step if forth else -step)) % b
                else:
                    step = self._number(tweak, r, right, a)
                    left = (left + (step if forth else -step)) % a
            value = left * b + right
            if value < size:
                return value

    def permute(self, value: int, size: int, tweak: str) -> int:
        """A permutation of 0 to size-1 that leaves nothing where it is: a step in the order that the network gives."""
        if size < 2:
            return value
        return self._walk((self._walk(value, size, tweak, True) + 1) % size, size, tweak, False)

    def letters(self, s: str, tweak: str, fold: bool = True, spoken: bool = False) -> str:
        """Digits to digits, letters to letters of the same script and case; all else stays. With ``fold`` spellings that differ in case alone get surrogates that do, too.

        ``spoken``: vowels to vowels, consonants to consonants, and the last letter stays, as it often tells a name's gender.
        """
        low = [_LOWER.get(c, c) if fold else c for c in s]
        alphabets = [_spoken(c) if spoken else _alphabet(c) for c in low]
        if spoken and sum(map(bool, alphabets)) > 1:
            alphabets[-1] = ""
        value, total = 0, 1
        for c, a in zip(low, alphabets, strict=True):
            if a:
                value, total = value * len(a) + a.index(c), total * len(a)
        shape = "".join(a[0] if a else c for c, a in zip(low, alphabets, strict=True))
        value = self.permute(value, total, f"{tweak}|{shape}")
        out: list[str] = []
        for c, a, was in zip(reversed(low), reversed(alphabets), reversed(s), strict=True):
            if a:
                value, i = divmod(value, len(a))
                c = a[i].upper() if c != was else a[i]
            out.append(c if a else was)
        return "".join(reversed(out))

    def surrogate(self, kind: str, s: str) -> str:
        if (kind, s) not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[kind, s] = getattr(self, f"_{kind}")(s)
        return self.seen[kind, s]

    def _email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{self.letters(local, 'local')}@{self.letters(host, 'host')}.{top}"

    def _secret(self, s: str) -> str:
        m = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ", s)
        head = m[0] if m else ""
        body = s[len(head) :]
        if _HEX.fullmatch(body):
            # permuted again until it shows the case of the original
            capital, got = body.upper() == body, body
            while True:
                got = f"{self.permute(int(got, 16), 16 ** len(body), f'hex{len(body)}'):0{len(body)}x}"
                if capital or got.upper() != got:
                    return head + (got.upper() if capital else got)
        got = self.letters(body, "secret", False)
        while _HEX.fullmatch(got):
            got = self.letters(got, "secret", False)
        return head + got

    def _ip(self, s: str) -> str:
        # a part with a leading zero stays one
        parts = s.split(".")
        sizes = [10 if len(x) > 1 and x[0] == "0" else 256 for x in parts]
        value, total, out = 0, 1, []
        for x, size in zip(parts, sizes, strict=True):
            value, total = value * size + int(x), total * size
        value = self.permute(value, total, "ip" if total == 1 << 32 else f"ip|{sizes}")
        for size in reversed(sizes):
            value, i = divmod(value, size)
            out.append(f"{i:02d}" if size == 10 else str(i))
        return ".".join(reversed(out))

    def _ip6(self, s: str) -> str:
        # the colons, the digits of each group and the class of case stay
        digits, shape, case = s.replace(":", ""), re.sub("[^:]", "x", s), _case(s)
        used = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF", "mixed": "0123456789abcdefABCDEF"}[case]
        while True:
            value = 0
            for c in digits:
                value = value * len(used) + used.index(c)
            value, got = self.permute(value, len(used) ** len(digits), f"ip6|{case}|{shape}"), []
            for _ in digits:
                value, i = divmod(value, len(used))
                got.append(used[i])
            digits = "".join(reversed(got))
            if _case(digits) == case:
                new = iter(digits)
                return "".join(c if c == ":" else next(new) for c in s)

    def _digits(self, s: str, keep: int, tweak: str, check=None) -> str:
        """Digits after the first ``keep`` permuted, punctuation kept; ``check`` makes the last digit."""
        d = [c for c in s if c.isdigit()]
        body = d[keep : len(d) - bool(check)]
        value = self.permute(int("".join(body) or "0"), 10 ** len(body), f"{tweak}|{''.join(d[:keep])}|{len(d)}")
        new = d[:keep] + list(f"{value:0{len(body)}d}" if body else "")
        if check:
            new.append(check(new))
        got = iter(new)
        return "".join(next(got) if c.isdigit() else c for c in s)

    def _card(self, s: str) -> str:
        d = [int(c) for c in s if c.isdigit()]
        # one that is valid stays valid, one that isn't permutes whole: both are one to one, and never meet
        if _luhn(d[:-1]) == str(d[-1]):
            return self._digits(s, 1, "card", lambda new: _luhn([int(c) for c in new]))
        got = self._digits(s, 1, "number")
        while _luhn([int(c) for c in got if c.isdigit()][:-1]) == [c for c in got if c.isdigit()][-1]:
            got = self._digits(got, 1, "number")
        return got

    def _ssn(self, s: str) -> str:
        return self._digits(s, 0, "ssn")

    def _phone(self, s: str) -> str:
        m = re.match(r"\+\d{1,3}(?=[ .(-])", s)
        return self._digits(s, len(m[0]) - 1 if m else 0, "phone")

    def _iban(self, s: str) -> str:
        flat = s.replace(" ", "")
        body = self.letters(flat[4:], "iban")
        n = int("".join(str(int(c, 36)) for c in body + flat[:2] + "00"))
        new = iter(flat[:2] + f"{98 - n % 97:02d}" + body)
        return "".join(c if c == " " else next(new) for c in s)

    def _name(self, s: str) -> str:
        return re.sub(r"[^ \-'’]+", lambda m: self._one_name(m[0]), s)

    def _one_name(self, s: str) -> str:
        if s[1:] != s[1:].lower() and not s.isupper():
            return self.letters(s, "name", spoken=True)  # other mixtures of case are apart from all that follows, as the mixture stays
        if known := _GIVEN_AT.get(s.lower()):
            (script, gender), i = known
            names = GIVEN[script, gender]
            turn = 1 + self._number(f"given|{script}|{gender}", 0, 0, len(names) - 1)
            got = names[(i + turn) % len(names)]  # never the same name
            return got.upper() if s.isupper() else got
        got = self.letters(s, "name", spoken=True)
        while got.lower() in _GIVEN_AT:  # given names are the images of given names alone
            got = self.letters(got, "name", spoken=True)
        return got


_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")

_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
]
_ALPHABET_OF = {c: a for a in _ALPHABETS for c in a}
#: Lower case of the capitals above; other letters keep their case class as an alphabet of its own.
_LOWER = {c.upper(): c for a in _ALPHABETS for c in a if c.islower() and c.upper() in _ALPHABET_OF}


_VOWELS = ["aeiou", "AEIOU", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "αεηιουω", "ΑΕΗΙΟΥΩ"]


def _spoken(c: str) -> str:
    """The vowels or the consonants among the letters that ``_alphabet`` gives; an alphabet without vowels of its own stays whole."""
    every = _alphabet(c)
    vowels = next((v for v in _VOWELS if v[0] in every), "")
    return vowels if c in vowels else "".join(x for x in every if x not in vowels)


def _case(s: str) -> str:
    """Of hexadecimal digits: whether capitals are among the letters, and small ones beside them."""
    if not re.search("[A-F]", s):
        return "lower"
    return "mixed" if re.search("[a-f]", s) else "upper"


def _alphabet(c: str) -> str:
    """All characters of the script and case of ``c``; none for what stays."""
    if c not in _ALPHABET_OF and c.isalpha():
        # other scripts: the letters of the same category in a run of 256 code points
        lo = ord(c) & ~0xFF
        kind = unicodedata.category(c)
        run = "".join(x for x in map(chr, range(lo, lo + 256)) if unicodedata.category(x) == kind and x not in "".join(_ALPHABETS))
        for x in run:
            _ALPHABET_OF[x] = run
    return _ALPHABET_OF.get(c, "")


def _luhn(d: list[int]) -> str:
    total = sum(x if i % 2 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
    return str(-total % 10)


def replace(text: str, keyed: Keyed) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, original, surrogate) of each finding."""
    out, at, said = [], 0, []
    for a, b, kind in find(text):
        new = keyed.surrogate(kind, text[a:b])
        out += [text[at:a], new]
        said.append((kind, text[a:b], new))
        at = b
    return "".join([*out, text[at:]]), said


def replace_pii(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """``docs`` with surrogates in the text, and ``_n_entities``, ``_kinds``."""
    apart = Apart(docs)
    at = apart.name(text_col)

    def run(batches):
        keyed = Keyed(key)
        for batch in batches:
            texts, n, kinds = [], [], []
            for t in batch.column(batch.schema.get_field_index(at)):
                text = t.as_py()
                new, said = replace(text, keyed) if text is not None else (None, [])
                texts.append(new)
                n.append(len(said))
                kinds.append(",".join(sorted({k for k, _, _ in said})))
            cols = [pa.array(texts, pa.string()) if f.name == at else batch.column(i) for i, f in enumerate(batch.schema)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(kinds, pa.string())], names=[*batch.schema.names, "_n_entities", "_kinds"])

    text_batches(docs)
    own = apart.df.withColumn(at, F.col(at).cast("string"))
    schema = T.StructType([*own.schema.fields, T.StructField("_n_entities", T.LongType()), T.StructField("_kinds", T.StringType())])
    return apart.back(own.mapInArrow(run, schema), "_n_entities", "_kinds")


def surrogate_map(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Distinct (kind, original, surrogate) over all documents: holds personal data, for audits alone."""

    def run(batches):
        keyed = Keyed(key)
        for batch in batches:
            rows = {x for t in batch.column(0) if t.as_py() is not None for x in replace(t.as_py(), keyed)[1]}
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "original", "surrogate"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind string, original string, surrogate string").distinct()


def collisions(docs: DataFrame, text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Surrogates that stand for several originals, over all documents; none if distinctness and coreference hold."""
    return surrogate_map(docs, text_col, key).groupBy("kind", "surrogate").agg(F.count_distinct("original").alias("originals")).where(F.col("originals") > 1)


def pii_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities, kinds."""
    got = replace_pii(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return got.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))
