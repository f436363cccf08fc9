"""Personal data replaced by surrogates.

Detected entities get keyed replacements of the same kind: the digits, letter cases, separators, check digits, script
and gender of the original. One entity has one surrogate in the whole corpus, however it is written, and two entities
never share one.

Kinds that are written by a fixed form (numbers, addresses, account numbers, secrets) have as many values as the form
allows, and few of some. Their surrogates come from a keyed permutation of all values of the form: distinct by
construction, never the entity itself, without a look at other entities. In a crowded form such a surrogate may be a
value that occurs elsewhere in the corpus, where it is replaced in turn; in a full one it must be.

Names and mail addresses have no such bound. Their surrogates are drawn for the distinct entities of the corpus, and
those that meet another's surrogate or a real entity are drawn again, from sets that grow with each attempt, until none
is left. Documents are then rewritten where they lie; only redrawn entities, if there are any, are joined to the
documents that mention them.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossgauge.llm.common import free_names, lean_memory, whole_text
from lossgauge.session import stable

_EMAIL = re.compile(r"(?<![\w.+-])[^\W_][\w.+-]*@(?:[^\W_][\w-]*\.)+[^\W\d_]{2,}", re.UNICODE)
_DIGITS = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)", re.ASCII)
_IBAN = re.compile(
    r"\b(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b", re.ASCII
)
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", re.ASCII)
_CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])", re.ASCII)
_PHONE = re.compile(
    r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"  # with an area code in brackets
    r"|(?<![\w.])\+\d(?:[ .-]?\d){7,13}(?![\w-])"  # with a country code
    r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"  # plain
    r"|(?<![\w.-])(?<!\d )[2-9]\d{2} \d{3} \d{4}(?![\w-])(?! \d)",  # with blanks
    re.ASCII,
)
# national numbers: the leading zero, then groups with blanks, slashes or dashes between
_NATIONAL = re.compile(r"(?<![\w.,:/+-])(?<!\d )0[1-9]\d{0,4}(?:(?: ?[/-] ?| )\d{2,8}){1,5}(?![\w-]|/\d|[.,:]\d| \d)", re.ASCII)
# the same in one piece
_NATIONAL_PLAIN = re.compile(r"(?<![\w.,:/+-])0[1-9]\d{8,9}(?![\w-]|/\d|[.,:]\d)", re.ASCII)
_IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{0,4})(?![\w:]|\.\d)", re.ASCII)
# What access keys begin with
KEY_HEADS = ("AKIA", "ASIA", "ghp_", "sk-", "xoxb-", "xoxp-")
_ACCESS_KEY = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:ghp_|sk-|xox[bp]-)[\w-]{16,}", re.ASCII)
_ASSIGNED = re.compile(
    r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{8,}={0,2})"
)

# Titles by gender, those of both, and given names by gender
TITLES = {
    "f": (
        "Mrs", "Ms", "Miss", "Madam", "Lady", "Dame", "Frau", "Fräulein", "Señora", "Señorita", "Sra", "Srta", "Doña", "Dra",
        "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "Госпожа",
    ),
    "m": ("Mr", "Sir", "Lord", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин"),
    "": ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Mx", "Rev", "Доктор", "Профессор"),
}
GIVEN = {
    "f": (
        "Anna", "Maria", "Julia", "Laura", "Sarah", "Emma", "Sophie", "Claire", "Helen", "Alice", "Elena", "Carmen",
        "Lucia", "Marta", "Ingrid", "Greta", "Nadine", "Camille", "Isabel", "Teresa", "Diana", "Ruth", "Nora", "Olivia",
    ),
    "m": (
        "John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Daniel", "Martin", "Pedro", "Carlos",
        "Luis", "Diego", "Pierre", "Jacques", "Henri", "Olivier", "Klaus", "Stefan", "Jürgen", "Walter", "Oscar", "Victor",
    ),
}
GIVEN_CYRILLIC = {
    "f": ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Светлана", "Татьяна"),
    "m": ("Иван", "Сергей", "Андрей", "Дмитрий", "Алексей", "Николай", "Павел", "Михаил"),
}
# Given names that are found but never drawn
MORE_GIVEN = {
    "f": """Abigail Adriana Agnes Alba Alejandra Alexandra Amanda Amelia Amélie Ana Andrea Angela Anja Anke Anne Annette Antonia
        Astrid Aurélie Barbara Beatrice Beatriz Bettina Birgit Brigitte Caroline Catherine Cecilia Céline Charlotte Chiara
        Christina Christine Clara Claudia Cristina Daniela Deborah Dolores Dorothea Edith Elisabeth Elise Elizabeth Ella Emily
        Emilia Erika Esther Eva Evelyn Fatima Federica Fiona Franziska Françoise Gabriela Gabriele Giulia Gloria Hannah Hanna
        Heike Heidi Inés Inge Ingeborg Irene Irina Isabella Isabelle Jacqueline Jana Jane Janet Jennifer Jessica Joanna Johanna
        Juana Judith Juliane Karen Karin Katharina Katherine Kathrin Katja Kelly Kerstin Laetitia Lea Lena Leonie Linda Lisa
        Louise Lucía Luise Luisa Magdalena Manon Manuela Margaret Margarita María Marie Marina Marion Marlene Martha Martina
        Mary Mathilde Megan Melanie Mercedes Mia Michelle Mónica Monica Monika Nancy Natalia Natalie Nathalie Nicole Nina Olga
        Patricia Paula Petra Pilar Rachel Rebecca Regina Renate Rita Rocío Rosa Sabine Samantha Sandra Sara Silvia Simone Sofia
        Sofía Sonia Stefanie Stephanie Susan Susanne Sylvie Tanja Tatiana Theresa Ursula Ute Valentina Valerie Vanessa Vera
        Verónica Veronika Victoria Virginie Viviane Yolanda Yvonne Zoe""".split()
    + "Александра Анастасия Валентина Галина Дарья Екатерина Ксения Людмила Марина Надежда Нина София Юлия".split(),
    "m": """Aaron Adam Adrian Ahmed Alain Alan Albert Alberto Alejandro Alessandro Alex Alexander Alexandre Alfonso Ali Álvaro
        Anders Andreas Andrés Andrew Ángel Anthony Antoine Anton Antonio Arnaud Arthur Axel Benjamin Bernard Bernd Björn Brian
        Bruno Charles Christian Christoph Christophe Christopher Claude Dennis Dieter Dirk Dominik Donald Edgar Edward Eduardo
        Emil Emilio Emmanuel Enrique Eric Erich Erik Ernst Fabian Felipe Felix Fernando Florian Francesco Francisco Frank Franz
        François Frédéric Friedrich Fritz Gabriel Gary George Georg Georges Gérard Gerhard Gilles Giovanni Giuseppe Gonzalo
        Gregor Gregory Guillaume Gustav Hans Harald Harry Heinrich Heinz Helmut Henry Herbert Hermann Hugo Ian Ignacio Ivan
        Jack Jacob Jaime Jakob Jan Javier Jean Jens Jeremy Joachim Joaquín Jochen Johann Johannes Jonas Jonathan Jorge José Jose
        Joseph Juan Jules Julian Julien Kai Karl Karsten Kenneth Kevin Konrad Kurt Lars Laurent Leo Leon Leonard Lorenzo Louis
        Luc Luca Lucas Ludwig Lukas Lutz Manfred Manuel Marc Marcel Marco Marcus Mario Mark Markus Mateo Matteo Matthew Matthias
        Maurice Max Maximilian Miguel Mohamed Mohammed Moritz Nicholas Nicolas Niklas Nils Norbert Oliver Olaf Otto Pablo Pascal
        Patrick Philip Philipp Philippe Rafael Rainer Ralf Ramón Raphael Raúl René Ricardo Richard Roberto Roger Roland Rolf
        Roman Ronald Rudolf Ryan Salvador Samuel Santiago Scott Sebastian Sébastien Sergio Simon Stephan Stephen Steven Sven
        Theodor Theo Thierry Tim Timothy Tobias Tom Tomás Udo Ulrich Uwe Vicente Vincent Volker Werner Wilhelm William Wolfgang
        Xavier Yves""".split()
    + "Александр Антон Борис Василий Виктор Владимир Георгий Григорий Денис Евгений Игорь Константин Максим Олег Пётр".split(),
}
# A run of name words that holds one of these names a place, an institution or a work
NOT_PERSONS = set(
    """Academy Airport Avenue Bank Bay Beach Bridge Building Castle Cathedral Center Centre Church City Club College Company
    Corporation County Court Creek District Drive Falls Festival Foundation Gallery Garden Gardens Hall Harbour Hill Hospital
    Hotel Institute Island Islands Lake Lane Library Memorial Museum Palace Park Place Platz Plaza Prize River Road School
    Square Stadium Station Straße Street Theatre Tower Trust University Universität Valley Museumsplatz Bahnhof Flughafen""".split()
)
SYLLABLES = {
    "latin": ("bar", "den", "fal", "gor", "hel", "jan", "kel", "lor", "mar", "nev", "pol", "ren", "sal", "tor", "vel", "wen"),
    "cyrillic": ("бар", "ден", "фал", "гор", "хел", "кал", "лор", "мар", "нев", "пол", "рен", "сал", "тор", "вел", "зам", "жан"),
}

_UPPER = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĖĘĚĞĢĪİĶĹĻĽŁŃŅŇŌŐŒŔŘŚŞŠŢŤŪŮŰŸŹŻŽΆ-ΏΑ-ΩЀ-Я"
_CAPITALISED = rf"[{_UPPER}][^\W\d_]+(?:[-'’][^\W\d_]+)*"
_TITLE_OF = {t: g for g, titles in TITLES.items() for t in titles}
_GIVEN_OF = {n: g for lists in (MORE_GIVEN, GIVEN_CYRILLIC, GIVEN) for g, names in lists.items() for n in names}
# what may stand between two words of a name; after a title, also a point
_BETWEEN = rf"\.? (?:(?:von|vom|van|der|den|de|del|della|di|da|dos|du|la|las|los|zu|ter) |[{_UPPER}]\. ?)*"
_NAME_WORD = re.compile(rf"\b{_CAPITALISED}")
_NAME_RUN = re.compile(rf"\b{_CAPITALISED}(?:{_BETWEEN}{_CAPITALISED})+")
_NAME_CUES = {*_TITLE_OF, *_GIVEN_OF}
_CUE_WORD = re.compile(rf"[{_UPPER}][^\W\d_]+")
_CARD_CUE = re.compile(
    r"\b(?:card|visa|mastercard|amex|karte|kreditkarte|kartennummer|carte|tarjeta|карта|карты)\b[^\w\n]*(?:\w+[^\w\n]+){0,2}$",
    re.IGNORECASE,
)

NAME_KINDS = ("given_f", "given_m", "surname")


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text, flags=re.ASCII)


def _luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a sound card number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, entity) in order of precedence; spans may overlap. An entity is written one way only."""
    if "@" in text:
        for m in _EMAIL.finditer(text):
            yield m.start(), m.end(), "email", m.group().lower()
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            yield m.start(1), m.end(1), "secret", m.group(1)
    if any(head in text for head in KEY_HEADS):
        for m in _ACCESS_KEY.finditer(text):
            yield m.start(), m.end(), "secret", m.group()
    if _DIGITS.search(text):
        if ":" in text:
            for m in _IPV6.finditer(text):
                if entity := _ipv6(m.group()):
                    yield m.start(), m.end(), "ipv6", entity
        for m in _IP.finditer(text):
            yield m.start(), m.end(), "ip", m.group()
        yield from _ibans(text)
        for m in _SSN.finditer(text):
            yield m.start(), m.end(), "ssn", _digits(m.group())
        for m in _CARD.finditer(text):
            number = _digits(m.group())
            if _luhn(number) == 0 or _CARD_CUE.search(text, max(0, m.start() - 40), m.start()):
                yield m.start(), m.end(), "card", number
        for m in _PHONE.finditer(text):
            found = _digits(m.group())
            if 7 <= len(found) <= 15:
                yield m.start(), m.end(), "phone", found[-10:]
        for pattern in (_NATIONAL, _NATIONAL_PLAIN):
            for m in pattern.finditer(text):
                found = _digits(m.group())
                if 9 <= len(found) <= 13:
                    yield m.start(), m.end(), "phone", found[1:][-10:]
    if not _NAME_CUES.isdisjoint(_CUE_WORD.findall(text)):
        yield from _names(text)


def _ipv6(text: str) -> str | None:
    """The address in full, if it is one. A pair of colons alone is none."""
    try:
        return ipaddress.IPv6Address(text).exploded if _DIGITS.search(text) else None
    except ValueError:
        return None


def _ibans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Account numbers, without a word behind that looks like another group."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.end()
        ends = [m.start() + i for i, c in enumerate(m.group()) if c == " "] + [m.end()]
        for end in reversed(ends):
            plain = text[m.start() : end].replace(" ", "").upper()
            if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
                yield m.start(), end, "iban", plain
                at = end
                break


def _names(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Runs of name words after titles or from a known given name on, and each of their words wherever the text repeats it.

    The last word of a run is the surname, the others are given names. Particles and initials within a run stay.
    """
    surnames, given = set(), {}
    for run in _NAME_RUN.finditer(text):
        words = list(_NAME_WORD.finditer(text, run.start(), run.end()))
        if not NOT_PERSONS.isdisjoint(m.group() for m in words):
            continue
        gaps = ["", *(text[a.end() : b.start()] for a, b in zip(words, words[1:]))]
        at = 0
        while at < len(words):
            first, gender = at, ""
            while first < len(words) and words[first].group() in _TITLE_OF:
                gender = gender or _TITLE_OF[words[first].group()]
                first += 1
            if first == len(words) or (first == at and words[first].group() not in _GIVEN_OF):
                at += 1
                continue
            end = first + 1
            while end < len(words) and not gaps[end].startswith("."):
                end += 1
            names, titled, at = words[first:end], first > at, end
            if not titled and len(names) < 2:
                continue
            head = names[0].group()
            gender = gender or _GIVEN_OF.get(head) or ("f" if head[-1] in "aа" else "m")
            for m in names[:-1]:
                given.setdefault(m.group(), gender)
                yield m.start(), m.end(), f"given_{gender}", m.group().lower()
            surnames.add(names[-1].group())
            yield names[-1].start(), names[-1].end(), "surname", names[-1].group().lower()
    for name in sorted(surnames):
        for m in re.finditer(rf"\b{re.escape(name)}\b", text):
            yield m.start(), m.end(), "surname", name.lower()
    for name, gender in sorted(given.items()):
        for m in re.finditer(rf"\b{re.escape(name)}\b", text):
            yield m.start(), m.end(), f"given_{gender}", name.lower()


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """Entities of a text from left to right, without overlaps: of two that overlap the earlier kind stays."""
    kept, taken = [], None
    for span in _spans(text or ""):
        start, end = span[:2]
        taken = taken or bytearray(len(text))
        if not any(taken[start:end]):
            taken[start:end] = b"\1" * (end - start)
            kept.append(span)
    return sorted(kept)


class _Stream:
    """Keyed pseudo-random choices for one entity."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed = hashlib.blake2b(f"{kind}\0{attempt}\0{entity}".encode("utf-8", "surrogatepass"), key=key).digest()
        self.block, self.rest = 0, b""

    def below(self, n: int) -> int:
        if len(self.rest) < 4:
            self.rest += hashlib.blake2b(self.seed + self.block.to_bytes(4, "little")).digest()
            self.block += 1
        value, self.rest = int.from_bytes(self.rest[:4], "little"), self.rest[4:]
        return value % n

    def like(self, text: str) -> str:
        """Another text of the same shape: digits for digits, letters of the same case and script for letters."""
        out = []
        for c in text:
            if c.isdecimal() and c.isascii():
                out.append(str(self.below(10)))
            elif c.isalpha():
                first = "а" if "Ѐ" <= c <= "ӿ" else "α" if "Ͱ" <= c <= "Ͽ" else "a"
                letter = chr(ord(first) + self.below(17 if first == "α" else 26))
                out.append(letter.upper() if c.isupper() else letter)
            else:
                out.append(c)
        return "".join(out)


# kinds whose surrogates are drawn and checked; those of all others are permuted
DRAWN_KINDS = ("email", "ipv6", *NAME_KINDS)
FEISTEL_ROUNDS = 8


class Permutation:
    """A keyed permutation of the numbers below ``size`` that leaves none in its place, one cycle through all of them.

    Numbers are split in two parts that scramble each other in rounds, over a rectangle that just covers them; what falls
    outside is scrambled again. The permutation scrambles, takes the next number, and undoes the scrambling.
    """

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode("utf-8", "surrogatepass"), size
        self.high = math.isqrt(max(size - 1, 0)) + 1
        self.low = -(-size // self.high)

    def _round(self, i: int, part: int) -> int:
        data = b"%d\0%d\0%s" % (i, part, self.label)
        return int.from_bytes(hashlib.blake2b(data, key=self.key).digest(), "little")

    def _scramble(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.low)
            for i in range(FEISTEL_ROUNDS):
                a = (a + self._round(2 * i, b)) % self.high
                b = (b + self._round(2 * i + 1, a)) % self.low
            x = a * self.low + b
            if x < self.size:
                return x

    def _unscramble(self, x: int) -> int:
        while True:
            a, b = divmod(x, self.low)
            for i in reversed(range(FEISTEL_ROUNDS)):
                b = (b - self._round(2 * i + 1, a)) % self.low
                a = (a - self._round(2 * i, b)) % self.high
            x = a * self.low + b
            if x < self.size:
                return x

    def image(self, x: int, fits=None) -> int:
        """The number that stands for ``x``. With ``fits``, which holds for ``x`` too, the permutation is followed up to
        a number for which it holds; this is a permutation of those numbers."""
        at = self._scramble(x)
        while True:
            at = (at + 1) % self.size
            y = self._unscramble(at)
            if fits is None or fits(y):
                return y


def _alphabet(c: str) -> str | None:
    if c.isdecimal() and c.isascii():
        return "0123456789"
    for first, n in (("a", 26), ("A", 26), ("а", 32), ("А", 32), ("α", 17), ("Α", 17)):
        if ord(first) <= ord(c) < ord(first) + n:
            return "".join(chr(ord(first) + i) for i in range(n))
    return None


def _permuted(key: bytes, kind: str, text: str, alphabets: list[str | None] | None = None, fits=None) -> str:
    """The image of ``text`` among the texts of its form: digits for digits, letters for letters of one case and script,
    other characters stay. ``alphabets`` may give the characters of each place; ``fits`` narrows the texts, this one
    among them."""
    alphabets = alphabets or [_alphabet(c) for c in text]
    places = [(i, a) for i, a in enumerate(alphabets) if a]

    def number(value: str) -> int:
        n = 0
        for i, a in places:
            n = n * len(a) + a.index(value[i])
        return n

    def written(n: int) -> str:
        out = list(text)
        for i, a in reversed(places):
            n, at = divmod(n, len(a))
            out[i] = a[at]
        return "".join(out)

    form = "".join(c if not a else a[0] for c, a in zip(text, alphabets))
    size = math.prod(len(a) for _, a in places)
    if size < 2:
        return text
    check = None if fits is None else lambda n: fits(written(n))
    return written(Permutation(key, f"{kind}\0{form}\0{len(places)}", size).image(number(text), check))


_PRIVATE = re.compile(r"(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
_HEX_FORMS = (re.compile("[0-9a-f]+"), re.compile("[0-9A-F]+"))


def _hex_digits(body: str) -> str | None:
    """The digits of a body that is all hexadecimal, in one case."""
    return next((d for r, d in zip(_HEX_FORMS, ("0123456789abcdef", "0123456789ABCDEF")) if r.fullmatch(body)), None)


def _permuted_kind(key: bytes, kind: str, entity: str) -> str:
    if kind == "ip":
        kept = m.group() if (m := _PRIVATE.match(entity)) else ""
        octets = [int(x) for x in entity[len(kept) :].split(".")]

        def address(n: int) -> str:
            return kept + ".".join(str(n >> 8 * i & 255) for i in reversed(range(len(octets))))

        number = sum(x << 8 * i for i, x in enumerate(reversed(octets)))
        # a public address stays public
        public = None if kept else lambda n: not _PRIVATE.match(address(n))
        return address(Permutation(key, f"ip\0{kept}", 256 ** len(octets)).image(number, public))
    if kind == "card":
        # the first digit stays, the last checks as well or as badly as the original
        body = entity[0] + _permuted(key, "card", entity[1:-1])
        off = (int(entity[-1]) + _luhn(entity[:-1] + "0")) % 10
        if off:
            off = 1 + Permutation(key, "card\0check", 9).image(off - 1)
        return body + str((off - _luhn(body + "0")) % 10)
    if kind == "phone":
        digits = "0123456789"
        return _permuted(key, "phone", entity, ["23456789" if entity[0] in "23456789" else "01"] + [digits] * (len(entity) - 1))
    if kind == "ssn":

        def issued(number: str) -> bool:
            return "100" <= number[:3] < "666" and number[3:5] > "00" and number[5:] > "0000"

        like = issued(entity)
        return _permuted(key, "ssn", entity, fits=lambda number: issued(number) == like)
    if kind == "iban":
        rest = _permuted(key, f"iban{entity[:2]}", entity[4:])
        return entity[:2] + _iban_check(entity[:2], rest) + rest
    head = m.group() if (m := re.match(r"AKIA|ASIA|ghp_|sk-|xox[bp]-", entity)) else ""
    body = entity[len(head) :]
    if digits := _hex_digits(body):
        # digits alone are hexadecimal in either case: such a body stays with the lower one
        return head + _permuted(key, "secret", body, [digits] * len(body), lambda x: _hex_digits(x) == digits)
    return head + _permuted(key, "secret", body, fits=lambda x: _hex_digits(x) is None)


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The replacement of an entity, in the one way entities are written. Attempts differ for drawn kinds only."""
    if kind not in DRAWN_KINDS:
        return _permuted_kind(key, kind, entity)
    draw = _Stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        inner = [draw.like(x) for x in labels[: max(1, len(labels) - 2)]]
        more = "".join(str(draw.below(10)) for _ in range(attempt))
        return f"{draw.like(local)}{more}@{'.'.join(inner)}.example.{('com', 'net', 'org')[draw.below(3)]}"
    if kind == "ipv6":
        # of the block for documentation
        return "2001:0db8:" + ":".join("".join("0123456789abcdef"[draw.below(16)] for _ in range(4)) for _ in range(6))
    script = "cyrillic" if re.search("[Ѐ-ӿ]", entity) else "latin"
    if kind == "surname":
        return "".join(SYLLABLES[script][draw.below(16)] for _ in range(3 + attempt // 2))
    names = (GIVEN_CYRILLIC if script == "cyrillic" else GIVEN)[kind[-1]]
    return "-".join(names[draw.below(len(names))].lower() for _ in range(1 + attempt // 2))


def render(kind: str, original: str, entity: str, replacement: str) -> str:
    """``replacement`` written as ``original`` writes ``entity``."""
    if kind in ("card", "phone", "ssn"):
        kept = len(_digits(original)) - len(entity)  # a country code stays
        fresh, seen, out = iter(replacement), 0, []
        for c in original:
            if c.isdecimal():
                seen += 1
                c = next(fresh) if seen > kept else c
            out.append(c)
        return "".join(out)
    if kind == "iban":
        fresh = iter(replacement.lower() if original[0].islower() else replacement)
        return "".join(c if c == " " else next(fresh) for c in original)
    if kind in NAME_KINDS:
        return replacement.upper() if original.isupper() else replacement.title()
    if kind == "email" and original.isupper():
        return replacement.upper()
    return replacement


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_hash, kind, entity) of all texts, each once, of the kinds whose surrogates are drawn."""

    def look(batches):
        lean_memory()
        for batch in batches:
            found = {
                (h, kind, entity)
                for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for _, _, kind, entity in find(text)
                if kind in DRAWN_KINDS
            }
            columns = list(zip(*found)) if found else [[], [], []]
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["text_hash", "kind", "entity"]
            )

    text = whole_text(text_col)
    rows = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(look, "text_hash long, kind string, entity string").distinct()


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, attempt, surrogate) of distinct (kind, entity), with distinct surrogates that are no entity.

    For the drawn kinds. In each round those that meet a surrogate drawn in an earlier attempt, or by a smaller entity,
    or an entity of the corpus, are drawn again. The sets they are drawn from grow with the attempts without end, so the
    rounds do end.
    """

    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, *row) for row in zip(kind, entity, attempt)], dtype=object)

    entities = entities.select("kind", "entity")
    real = entities.select("kind", F.col("entity").alias("surrogate")).withColumn("real", F.lit(True))
    current = entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", draw("kind", "entity", "attempt"))
    while True:
        current = stable(current.select("kind", "entity", "attempt", "surrogate"))
        owner = current.groupBy("kind", "surrogate").agg(
            F.count("*").alias("n"), F.min(F.struct("attempt", "entity")).alias("owner")
        )
        owner = owner.join(real, ["kind", "surrogate"], "left").where("n > 1 OR real")
        if owner.isEmpty():
            return current
        judged = current.join(owner, ["kind", "surrogate"], "left")
        again = F.coalesce(F.col("real") | (F.struct("attempt", "entity") != F.col("owner")), F.lit(False))
        judged = judged.withColumn("again", again).withColumn("attempt", F.col("attempt") + F.col("again").cast("int"))
        fresh = draw("kind", "entity", "attempt")
        current = (
            judged.where("NOT again")
            .select("kind", "entity", "attempt", "surrogate")
            .unionByName(judged.where("again").select("kind", "entity", "attempt", fresh.alias("surrogate")))
        )


def _rewrite(text: str | None, key: bytes, attempts: dict) -> tuple[str | None, int]:
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, kind, entity in found:
        replacement = surrogate(key, kind, entity, attempts.get((kind, entity), 0))
        out += [text[at:start], render(kind, text[start:end], entity, replacement)]
        at = end
    return "".join(out) + text[at:], len(found)


def mask(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with personal data of ``text_col`` replaced; all columns stay, and ``count_col``, a new column or one to replace, gets
    the number of replaced entities.

    Null texts stay null, texts without entities stay as they are. Rows are kept one by one, whatever their ids;
    an empty table gives an empty result.
    """
    named = stable(mentions(docs, text_col))
    redrawn = assign(named.select("kind", "entity").distinct(), key).where("attempt > 0")

    @F.pandas_udf("text string, n int")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        lean_memory()
        for texts, redrawn_there in batches:
            rows = []
            for text, redraws in zip(texts, redrawn_there):
                attempts = {} if redraws is None else {(r["kind"], r["entity"]): r["attempt"] for r in redraws}
                rows.append(_rewrite(text, key, attempts))
            yield pd.DataFrame({"text": [r[0] for r in rows], "n": [r[1] for r in rows]}, dtype=object).astype({"n": "int32"})

    kind = "array<struct<kind:string,entity:string,attempt:int>>"
    redraws, there_hash, own_hash, made = free_names(docs, "__redrawn", "__hash", "__text_hash", "__made")
    if redrawn.isEmpty():
        marked = docs.withColumn(redraws, F.lit(None).cast(kind))
    else:
        there = named.join(redrawn.select("kind", "entity", "attempt"), ["kind", "entity"])
        # stored, so that the join can be split where one text has very many copies
        there = stable(
            there.groupBy(F.col("text_hash").alias(there_hash)).agg(
                F.collect_list(F.struct("kind", "entity", "attempt")).alias(redraws)
            )
        )
        hashed = docs.withColumn(own_hash, F.xxhash64(whole_text(text_col)))
        marked = hashed.join(there, F.col(own_hash) == F.col(there_hash), "left")
    kept = [c for c in docs.columns if count_col is None or c.lower() != count_col.lower()]
    columns = [F.col(made)["text"].alias(c) if c == text_col else F.col(c) for c in kept]
    count = [F.col(made)["n"].alias(count_col)] if count_col else []
    return marked.withColumn(made, rewrite(F.col(text_col), F.col(redraws))).select(*columns, *count)
