r"""Personal data: detected entities get keyed surrogates of the same kind and format.

Detection is one alternation of patterns, whose branch gives the entity's type. A
surrogate depends on the key and on the entity's normal form alone, which all its
spellings share, so one person, number or address has the same surrogate in every
document and on every run (coreference).

Numbers, mailboxes and secrets are permuted: each character goes to another of its
class by a keyed Feistel network over the positions, so that two entities of one
format never share a surrogate, and as many surrogates exist as entities. The
country code of a phone and of an IBAN, the first digit's class of a phone, 10 and
127 in front of an IPv4 address, and the separators stay; check digits of cards and
IBANs are right in the surrogate where they were right in the entity. IPv6 addresses
are written in full. A single-character initial is permuted too.

Words, which are given names, surnames, domains, and secrets or mailboxes with
characters outside the listed alphabets, have no such space, and get a keyed hash
spelled as syllables of their script, or as letters and digits of a reserved domain. The first places
of a word tell its bucket, one of BUCKETS by another keyed hash, so words can only
clash within a bucket. Given names end by the gender that the title tells, or an -a
where it tells none; the stem is the same for all titles.

Distinctness is checked over the distinct entities of all documents: a bucket in
which two words share a surrogate, or have one that is itself a word of the
documents, is drawn again as a whole, and so is a kind in which whole entities
clash. What rewriting needs of that is one character for each bucket: a literal of
a fixed size, whatever the corpus. No text is shuffled, only distinct entities are;
texts are scanned twice, for the check and to be rewritten, by SQL functions only,
and one with no hint, which every pattern needs one of, is not looked at further.

What is not found: names without one of the titles or in capitals, letters after
the third word of a name, IPv6 addresses with :: that have no digit or look like
slices of a list (1::2, ::1), phones of fewer than nine digits, and national ones
that begin with 1. Ten digits that begin with 2 to 9, and ten or eleven that begin
with 0, count as a phone. Buckets hold tens of millions of distinct words of a class;
far more raise an error after MAX_ATTEMPTS draws.

Defined results: null texts stay null and have no entities; empty ones stay
empty; a very long text is rewritten whole; repeated rows are rewritten alike;
overlapping candidates are taken from left to right, the earlier branch first; an
empty table gives an empty one; other columns are carried untouched.
"""

from __future__ import annotations

import warnings
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.llm.frames import fresh, table
from relata.session import written

#: A word of a name, with inner capitals and apostrophes, after any initials.
NAME_PART = r"(?:\p{Lu}(?:\.[ -]?| ))*(?:\p{Lu}['’]\p{L}\p{Ll}+|\p{Lu}\p{Ll}+)(?:['’]?\p{Lu}\p{Ll}+)*"
#: Type and pattern, tried in this order at each place.
PATTERNS: tuple[tuple[str, str], ...] = (
    ("email", r"(?<![\p{L}\p{N}])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("mac", r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:])"),
    ("ipv6", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("ipv6", r"(?<![\p{L}\p{N}:])(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{2,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:|:(?::[0-9A-Fa-f]{1,4}){2,7})(?![\p{L}\p{N}:]|\.\d)"),
    ("ipv4", r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("secret", r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z_-]{20,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![\p{L}\p{N}])"),
    ("secret", r"(?<=[=: \"'])(?<=[=:] ?[\"']?)(?<=(?i:token|secret|password|passwd|api_key|apikey|access_key)[\"']? ?[=:] ?[\"']?)[^\s\"'=:]{6,}"),
    ("phone", r"(?=\+)(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("card", r"(?=\d)(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{4,5})(?![\d-])"),
    ("ssn", r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?=[\d(])(?<![\d-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-])"),
    ("phone", r"(?=[\d(])(?<![\p{L}\p{N}.,_/-])(?:(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}|[2-9]\d{9}|0\d{9,10}|(?=(?:[ /]?\d){9,12}(?!\d))0(?:\d{1,4} |\d{2,4}/)\d{2,4}(?: ?\d{2,4}){1,3})(?![\p{L}\p{N}_-]|[.,]\d)"),
    ("name", r"(?=[MDPHFSГ])(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? " + NAME_PART + "(?:[ -]" + NAME_PART + "){0,2}"),
)
#: Inside a word only a digit can begin an entity, which spares most characters the patterns.
ANY = r"(?:(?<![\p{L}\p{N}])(?=\S)|(?=\d))(?:" + "|".join(p for _, p in PATTERNS) + ")"
#: Groups of literals and a pattern: a text that for no group has one of the literals, if there are any, and the pattern, if there is one, has no entity.
#: Digits or @: email, ipv4, iban, phone, card, ssn; or a secret of letters alone. Then title: name; word: secret after a word; pairs and groups of letters: mac, ipv6; last: secrets by their form.
HINTS: tuple[tuple[tuple[str, ...], str], ...] = (
    ((), r"[0-9@]|[a-fA-F]{32}"),
    (("Mr", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Господин", "Госпожа"), r"(?=[MDPHFSГ])(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? \p{Lu}"),
    (("=", ":"), r"(?=[tTsSpPaA])(?i:token|secret|passw(?:or)?d|api_?key|access_key)[\"']? ?[=:]"),
    ((":",), r"[A-Fa-f]:[A-Fa-f]{1,4}:[A-Fa-f]"),
    (("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "eyJ"), ""),
)
#: Marks entities while a text is cut; texts that have it themselves are cut in another way.
MARK = "\x1f"
TITLE = r"^(Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? "
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
#: Script: a letter of it, 16 consonants, 4 vowels, endings for female, male and unknown.
SCRIPTS = (
    ("latin", r"[A-Za-zÀ-ɏ]", "bdfgklmnprstvzhj", "aeio", ("a", "o", "e")),
    ("cyrillic", r"\p{IsCyrillic}", "бвгдзклмнпрстфхж", "аеио", ("а", "ор", "ен")),
    ("greek", r"\p{IsGreek}", "βγδζθκλμνπρστφχξ", "αεηο", ("α", "ος", "η")),
)
#: A character is replaced by one of the first alphabet that has it.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MORE_LOWER = ("àáâãäåæçèéêëìíîïñòóôõöøùúûüýþÿ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω")
ALPHABETS = (DIGITS, LOWER, UPPER, *MORE_LOWER, *(a.replace("ÿ", "").upper() for a in MORE_LOWER))
HEX = "0123456789abcdef"
#: Country codes of phones by their first digits; all others have three.
COUNTRY = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Letters of a domain's surrogate after those of its bucket.
DOMAIN_LETTERS = "abcdefghijkmnpqrstuvwxyz23456789"
ROUNDS = 8
#: Buckets of each class of words: three hexadecimal digits.
BUCKETS = 4096
ATTEMPT = "0123456789abcdefghijklmnopqrstuvwxyz"
MAX_ATTEMPTS = len(ATTEMPT)
#: The key of tests and demonstrations; it is public, so surrogates made with it can be guessed back.
TEST_KEY = "relata-development-key"


def let(value: Column, body) -> Column:
    """body of a variable that holds the value, which is thus computed once however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def lets(values: list[Column], body) -> Column:
    """As `let`, for several values of which none depends on another."""
    return body(*values) if not values else let(values[0], lambda x: lets(values[1:], lambda *more: body(x, *more)))


def type_of(entity: Column) -> Column:
    """The type whose pattern the whole entity matches first; what is left was found after a word for a secret."""
    found = F.lit("secret")
    for name, pattern in reversed(PATTERNS):
        if not pattern.startswith("(?<="):
            found = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(found)
    return found


# Parts of entities


def _digits(entity: Column) -> Column:
    return F.regexp_replace(entity, r"\D", "")


def _chars(text: Column) -> Column:
    """The letters and digits of a text."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]"), F.lit(0))


def _letters(text: Column) -> Column:
    """The characters of a text."""
    return F.regexp_extract_all(text, F.lit("."), F.lit(0))


def _tokens(entity: Column) -> Column:
    """The words and initials of a name without its title."""
    return F.split(F.regexp_replace(entity, TITLE, ""), r"[ -]|(?<=\.)(?=\p{Lu})")


def _spelling(token: Column) -> Column:
    """What different spellings of a token of a name share."""
    return F.lower(F.translate(token, "’.", "'"))


def _is_initial(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}\.?$")


def _is_hex(secret: Column) -> Column:
    """So long that nothing else becomes the same by chance."""
    return secret.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")


def _listed(text: Column) -> Column:
    """Whether some character of a text is a letter or digit, and all that are belong to a listed alphabet."""
    return text.rlike(r"[\p{L}\p{N}]") & ~text.rlike(f"[\\p{{L}}\\p{{N}}&&[^{''.join(ALPHABETS)}]]")


def _octets(entity: Column) -> Column:
    return F.split(entity, r"\.").cast("array<int>")


def _groups(entity: Column) -> Column:
    """The eight groups of an IPv6 address as 32 hexadecimal digits."""

    def side(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), ":"), lambda x: x != "")

    def spread(left: Column, right: Column) -> Column:
        gap = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
        return F.array_join(F.transform(F.concat(left, gap, right), lambda x: F.lpad(x, 4, "0")), "")

    return lets([side(F.substring_index(entity, "::", 1)), side(F.when(entity.contains("::"), F.substring_index(entity, "::", -1)).otherwise(""))], spread)


def normal_form(kind: Column, entity: Column) -> Column:
    """What all spellings of one entity share."""
    name = F.array_join(F.transform(_tokens(entity), _spelling), " ")
    return (
        F.when(kind == "phone", F.concat(F.when(entity.startswith("+"), "+").otherwise(""), _digits(entity)))
        .when(kind.isin("card", "ssn"), _digits(entity))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "ipv4", F.array_join(_octets(entity).cast("array<string>"), "."))
        .when(kind == "ipv6", _groups(entity))
        .when(kind == "name", name)
        .when((kind == "secret") & ~_is_hex(entity), entity)
        .otherwise(F.lower(entity))
    )


# Keyed numbers and permutations


def _keyed(key: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(key), *parts)


def _number(hexes: Column, i: Column | int) -> Column:
    """The i-th number, 0 to 65535, of hexadecimal digits."""
    return F.conv(F.substring(hexes, (F.lit(i) if isinstance(i, int) else i) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _numbers(seed: Column, n: Column) -> Column:
    """n numbers from 0 to 65535."""
    blocks = F.transform(F.array_repeat(F.lit(0), F.ceil(n / 16).cast("int")), lambda _, b: F.sha2(F.concat_ws("\x1f", b.cast("string"), seed), 256))
    return let(F.array_join(blocks, ""), lambda hexes: F.transform(F.array_repeat(F.lit(0), n), lambda _, i: _number(hexes, i)))


def permuted(values: Column, radices: Column, seed: Column) -> Column:
    """The values, each from 0 to below its radix, under a keyed permutation of all such arrays: a Feistel network whose halves are added to by turns."""

    def turn(s: Column, r: Column) -> Column:
        drawn = _numbers(F.concat_ws("\x1f", seed, r.cast("string"), F.array_join(s["b"].cast("array<string>"), ",")), F.size(s["a"]))
        moved = F.zip_with(F.zip_with(s["a"], drawn, lambda x, y: x + y), s["ra"], lambda x, y: F.pmod(x, y))
        return F.struct(s["b"].alias("a"), moved.alias("b"), s["rb"].alias("ra"), s["ra"].alias("rb"))

    def whole(v: Column, r: Column, half: Column) -> Column:
        first, last = lambda x: F.slice(x, F.lit(1), half), lambda x: F.slice(x, half + 1, F.size(x) - half)
        start = F.struct(first(v).alias("a"), last(v).alias("b"), first(r).alias("ra"), last(r).alias("rb"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return lets([values, radices], lambda v, r: let(F.floor(F.size(v) / 2).cast("int"), lambda half: whole(v, r, half)))


def _woven(text: Column, new: Column) -> Column:
    """text with its letters and digits replaced by the members of `new`, as many as there are."""
    gaps = F.split(text, r"[\p{L}\p{N}]", -1)
    return let(gaps, lambda g: F.concat(g[0], F.array_join(F.zip_with(new, F.slice(g, F.lit(2), F.size(g) - 1), lambda a, b: F.concat(a, b)), "")))


# Check digits


def _checked(digits: Column) -> Column:
    """0 for a valid card number: the last digit, and every second before it, counts once, the others twice with nines cast out."""
    n = F.size(digits)
    each = F.transform(digits, lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, x: a + x), F.lit(10))


def _check_digit(body: Column) -> Column:
    """The digit that makes a valid card number of the digits before it."""
    return F.pmod(10 - _checked(F.concat(body, F.array(F.lit("0")))), F.lit(10))


def _check_number(country: Column, body: Column) -> Column:
    """The two check digits of an IBAN as a number: 98 less the remainder by 97 of body, country and 00, letters from A counting from 10."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + c.cast("int"), F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97)))
    return 98 - F.aggregate(_letters(F.concat(body, country, F.lit("00"))), F.lit(0), step)


# Words


class Draws:
    """Which attempt each bucket of words, and each kind, is at; of a fixed size."""

    def __init__(self, key: str):
        self.key = key
        self.words: dict[str, list[int]] = {}
        self.kinds: dict[str, int] = {}

    def again(self, clashes: list) -> None:
        for name, bucket in clashes:
            if bucket is None:
                self.kinds[name] = self.kinds.get(name, 0) + 1
            else:
                self.words.setdefault(name, [0] * BUCKETS)[bucket] += 1

    def of_kind(self, kind: Column) -> Column:
        out = F.lit("0")
        for name, n in self.kinds.items():
            out = F.when(kind == name, F.lit(ATTEMPT[n])).otherwise(out)
        return out

    def of_word(self, name: Column, bucket: Column) -> Column:
        out = F.lit("0")
        for known, at in self.words.items():
            out = F.when(name == known, F.substring(F.lit("".join(ATTEMPT[n] for n in at)), bucket + 1, F.lit(1))).otherwise(out)
        return out


def words_of(kind: Column, entity: Column) -> Column:
    """array<struct<class, word>>: the parts of an entity that a keyed hash replaces; for a name, one for each token, for a mailbox its domain and then, maybe, itself."""
    word = lambda c, w: F.struct(F.lit(c).alias("class"), w.alias("word"))
    classed = lambda t, i, n: F.when(_is_initial(t), "initial").when(i < n - 1, "given").otherwise("surname")
    names = let(_tokens(entity), lambda tokens: F.transform(tokens, lambda t, i: F.struct(classed(t, i, F.size(tokens)).alias("class"), _spelling(t).alias("word"))))
    local = F.lower(F.substring_index(entity, "@", 1))
    domain = F.array(word("domain", F.lower(F.substring_index(entity, "@", -1))))
    mail = F.when(_listed(local), domain).otherwise(F.concat(domain, F.array(word("mailbox", local))))
    every = F.when(kind == "name", names).when(kind == "email", mail).when((kind == "secret") & ~_is_hex(entity) & ~_listed(entity), F.array(word("secret", entity)))
    return F.coalesce(every, F.array().cast("array<struct<class:string,word:string>>"))


def bucket_of(name: Column, word: Column, draws: Draws) -> Column:
    """Three hexadecimal digits."""
    return F.substring(F.sha2(_keyed(draws.key, F.lit("bucket"), name, word), 256), F.lit(1), F.lit(3))


def _of_script(word: Column, part) -> Column:
    """part(consonants, vowels, endings) of the script of a word; the first script's if it has none of the others'."""
    out = part(*SCRIPTS[0][2:])
    for _, letter, *parts in SCRIPTS[1:]:
        out = F.when(word.rlike(letter), part(*parts)).otherwise(out)
    return out


def _pick(letters: Column, v: Column) -> Column:
    return F.substring(letters, F.pmod(v, F.length(letters)) + 1, F.lit(1))


def word_surrogate(name: Column, word: Column, draws: Draws) -> Column:
    """The replacement of a word, given its class: for names in lower case and without an ending."""

    def stem(bucket: Column, h: Column) -> Column:
        at = F.conv(bucket, 16, 10).cast("int")

        def syllables(consonants: Column, vowels: Column, b: Column) -> Column:
            first = [_pick(letters, F.shiftright(b, n)) for letters, n in ((consonants, 8), (vowels, 6), (consonants, 2), (vowels, 0))]
            return F.concat(*first, *[_pick(letters, _number(h, k)) for k, letters in enumerate((consonants, vowels, consonants, consonants, vowels, consonants, vowels, consonants))])

        return lets([_of_script(word, lambda c, v, e: F.lit(c)), _of_script(word, lambda c, v, e: F.lit(v)), at], syllables)

    def spelled(bucket: Column, h: Column) -> Column:
        letter = let(F.coalesce(*[F.when(F.instr(F.lit(a), F.substring(word, 1, 1)) > 0, F.lit(a)) for a in (LOWER, *MORE_LOWER)], F.lit(LOWER)), lambda a: _pick(a, F.instr(a, F.substring(word, 1, 1)) + _number(F.sha2(_keyed(draws.key, F.lit("initial")), 256), 0)))
        domain = F.concat(F.lit("d"), bucket, *[_pick(F.lit(DOMAIN_LETTERS), _number(h, k)) for k in range(5)], F.lit(".example"))
        mailbox = F.concat(F.lit("u"), bucket, F.substring(h, F.lit(1), F.lit(9)))
        secret = F.rpad(F.concat(bucket, h), F.length(word), h)
        return F.when(name == "domain", domain).when(name == "mailbox", mailbox).when(name == "secret", secret).when(name == "initial", letter).otherwise(stem(bucket, h))

    def hashed(bucket: Column) -> Column:
        return let(F.sha2(_keyed(draws.key, F.lit("word"), name, draws.of_word(name, F.conv(bucket, 16, 10).cast("int")), word), 256), lambda h: spelled(bucket, h))

    return let(bucket_of(name, word, draws), hashed)


# Surrogates of whole entities


def _name(entity: Column, drawn: Column) -> Column:
    title = F.regexp_extract(entity, TITLE, 1)
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")

    def each(token: Column, new: Column, i: Column, last: Column, g: Column) -> Column:
        ending = _of_script(token, lambda c, v, e: F.when((g == "f") | ((g == "n") & token.rlike("[aаα]$")), e[0]).when(g == "m", e[1]).otherwise(e[2]))
        return F.when(_is_initial(token), F.concat(F.upper(new), F.substring(token, 2, 1))).when(i < last, F.initcap(F.concat(new, ending))).otherwise(F.initcap(new))

    tokens = lambda t, g: F.transform(t, lambda x, i: each(x, drawn[i], i, F.size(t) - 1, g))
    return F.concat(F.regexp_extract(entity, TITLE, 0), F.array_join(lets([_tokens(entity), gender], tokens), " "))


def _places(kind: Column, entity: Column) -> Column:
    """struct<chars, alphabets, tweak>: what of an entity is permuted, by which alphabets, and what changes the permutation."""
    place = lambda chars, alphabet, tweak: let(chars, lambda c: F.struct(c.alias("chars"), F.transform(c, alphabet).alias("alphabets"), tweak.alias("tweak")))
    own = lambda c, i: F.coalesce(*[F.when(F.instr(F.lit(a), c) > 0, F.lit(a)) for a in ALPHABETS], c)
    first = lambda c, i: F.when((i == 0) & (c < "2"), c).when(i == 0, "23456789").otherwise(DIGITS)
    digits, bare, local = _digits(entity), F.replace(entity, F.lit(" "), F.lit("")), F.lower(F.substring_index(entity, "@", 1))
    country = F.when(entity.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
    hexes = F.when(kind == "ipv6", _groups(entity)).otherwise(F.lower(F.replace(entity, F.lit(":"), F.lit(""))))
    none = F.lit("")
    return (
        F.when(kind == "phone", lets([digits, country], lambda d, c: place(_letters(F.substring(d, F.length(c) + 1, F.length(d))), first, c)))
        .when(kind == "card", place(_letters(F.substring(digits, F.lit(1), F.length(digits) - 1)), own, none))
        .when(kind == "iban", place(_letters(F.substring(bare, F.lit(5), F.length(bare))), own, F.substring(bare, 1, 2)))
        .when(kind.isin("mac", "ipv6") | _is_hex(entity), place(_letters(hexes), lambda c, i: F.lit(HEX), none))
        .when(kind == "email", place(_chars(local), own, F.lower(F.substring_index(entity, "@", -1))))
        .otherwise(place(_chars(entity), own, none))
    )


def _octet(kind_of: str):
    """Octets stay octets, and numbers above stay above; the first octet stays if it is 10 or 127. Its place, the number of places, or back from the new place."""
    kept = lambda o, i: (i == 0) & o.isin(10, 127)
    if kind_of == "radix":
        return lambda o, i: F.when(o > 255, 744).when(kept(o, i), 1).when(i == 0, 254).otherwise(256)
    if kind_of == "value":
        return lambda o, i: F.when(o > 255, o - 256).when(kept(o, i), 0).when(i == 0, o - F.when(o > 127, 2).when(o > 10, 1).otherwise(0)).otherwise(o)
    return lambda o, i, v: F.when(o > 255, v + 256).when(kept(o, i), o).when(i == 0, v + F.when(v > 125, 2).when(v > 9, 1).otherwise(0)).otherwise(v)


def surrogate(kind_of: Column, entity_of: Column, draws: Draws) -> Column:
    """The replacement of an entity."""

    def finished(e: Column, kind: Column, old: Column, new: Column) -> Column:
        """The entity from its permuted characters, with check digits, case and separators."""
        cased = lambda x: F.when(e.rlike("[A-F]"), F.upper(x)).otherwise(x)
        off = F.substring(_digits(e), -1, 1).cast("int") - _check_digit(old)
        card = F.concat(new, F.array(F.pmod(_check_digit(new) + off, F.lit(10)).cast("string")))
        bare = F.replace(e, F.lit(" "), F.lit(""))
        country = F.substring(bare, 1, 2)
        told = F.substring(bare, 3, 2).cast("int") - _check_number(country, F.array_join(old, ""))
        iban = F.concat(_letters(F.concat(country, F.lpad(F.pmod(_check_number(country, F.array_join(new, "")) + told, F.lit(100)).cast("string"), 2, "0"))), new)
        phone = F.concat(_letters(F.substring(_digits(e), F.lit(1), F.length(_digits(e)) - F.size(new))), new)
        chars = F.when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when((kind == "mac") | _is_hex(e), F.transform(new, cased)).otherwise(new)
        return F.when(kind == "ipv6", F.regexp_replace(cased(F.array_join(new, "")), r"(.{4})(?=.)", "$1:")).otherwise(_woven(e, chars))

    def mail(e: Column, new: Column, drawn: Column) -> Column:
        local = F.substring_index(e, "@", 1)
        letters = F.zip_with(_chars(local), new, lambda o, n: F.when(o != F.lower(o), F.upper(n)).otherwise(n))
        return F.concat(F.when(F.size(drawn) > 1, drawn[1]).otherwise(_woven(local, letters)), F.lit("@"), drawn[0])

    def by_place(e: Column, kind: Column, seed: Column, drawn: Column) -> Column:
        def whole(place: Column, octets: Column) -> Column:
            values = F.when(kind == "ipv4", F.transform(octets, _octet("value"))).otherwise(F.zip_with(place["chars"], place["alphabets"], lambda c, a: F.instr(a, c) - 1))
            radices = F.when(kind == "ipv4", F.transform(octets, _octet("radix"))).otherwise(F.transform(place["alphabets"], lambda a: F.length(a)))

            def back(new: Column) -> Column:
                letters = F.zip_with(new, place["alphabets"], lambda v, a: F.substring(a, v + 1, F.lit(1)))
                address = F.array_join(F.transform(octets, lambda o, i: _octet("back")(o, i, new[i])).cast("array<string>"), ".")
                return F.when(kind == "ipv4", address).otherwise(let(letters, lambda x: F.when(kind == "email", mail(e, x, drawn)).otherwise(finished(e, kind, place["chars"], x))))

            return let(permuted(values, radices, F.concat_ws("\x1f", seed, place["tweak"])), back)

        return lets([_places(kind, e), F.when(kind == "ipv4", _octets(e))], whole)

    def whole(e: Column, kind: Column, seed: Column, drawn: Column) -> Column:
        return F.when(kind == "name", _name(e, drawn)).when((kind == "secret") & (F.size(drawn) > 0), drawn[0]).otherwise(by_place(e, kind, seed, drawn))

    def keyed(e: Column, kind: Column) -> Column:
        words = F.transform(words_of(kind, e), lambda w: word_surrogate(w["class"], w["word"], draws))
        return lets([_keyed(draws.key, F.lit("kind"), kind, draws.of_kind(kind)), words], lambda seed, drawn: whole(e, kind, seed, drawn))

    return lets([entity_of, kind_of], keyed)


def hinted(text: Column) -> Column:
    """Whether a text can have an entity at all."""
    every = []
    for literals, pattern in HINTS:
        some = reduce(or_, [text.contains(x) for x in literals]) if literals else None
        every.append(text.rlike(pattern) if some is None else some & text.rlike(pattern) if pattern else some)
    return reduce(or_, every)


def entities_in(text: Column) -> Column:
    """All entities of a text from left to right; none for texts without a hint."""
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def cut(text: Column) -> Column:
    """The text in pieces, of which every second is an entity; a single piece for texts without a hint."""
    marked = F.split(F.regexp_replace(text, f"({ANY})", f"{MARK}$1{MARK}"), MARK, -1)
    parts = F.split(text, f"(?:{ANY})", -1)
    twice = F.flatten(F.zip_with(parts, F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(0)), lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    return F.when(~hinted(text), F.array(text)).when(text.contains(MARK), twice).otherwise(marked)


def settle(docs: DataFrame, key: str, text_col: str = "text") -> Draws:
    """Draws under which no two entities of docs share a surrogate, and no word's surrogate is a word of docs."""
    found = docs.select(F.explode(entities_in(F.col(text_col))).alias("entity")).distinct()
    kind, entity = F.col("kind"), F.col("entity")
    known = found.withColumn("kind", type_of(entity)).withColumn("norm", normal_form(kind, entity))
    known = written(known.groupBy("kind", "norm").agg(F.min("entity").alias("entity")), "entities")
    words = written(known.select(F.explode(words_of(kind, entity)).alias("w")).select("w.class", "w.word").where("class <> 'initial'").distinct(), "words")
    draws = Draws(key)
    name, word = F.col("class"), F.col("word")
    for _ in range(MAX_ATTEMPTS):
        drawn = words.select("class", F.conv(bucket_of(name, word, draws), 16, 10).cast("int").alias("bucket"), word_surrogate(name, word, draws).alias("drawn"))
        shared = drawn.groupBy("class", "bucket", "drawn").count().where("count > 1").select("class", "bucket")
        real = drawn.join(words.select("class", F.col("word").alias("drawn")), ["class", "drawn"], "left_semi").select("class", "bucket")
        whole = known.select("kind", let(surrogate(kind, entity, draws), lambda new: normal_form(kind, new)).alias("drawn"))
        whole = whole.groupBy("kind", "drawn").count().where("count > 1").select("kind", F.lit(None).cast("int")).distinct()
        # at most BUCKETS for each of the five classes
        worded = [tuple(r) for r in shared.unionByName(real).distinct().collect()]
        # names and mailboxes are clear of clashes once their words are
        clashes = worded or [tuple(r) for r in whole.collect()]
        if not clashes:
            return draws
        draws.again(clashes)
    raise RuntimeError(f"surrogates still clash after {MAX_ATTEMPTS} attempts")


def rewrite(docs: DataFrame, key: str, text_col: str = "text", counts: str | None = None, draws: Draws | None = None) -> DataFrame:
    """docs with every entity replaced; with a column of their number named `counts`, if that is given."""
    draws = draws or settle(docs, key, text_col)
    pieces, text = fresh(docs, "_pieces"), F.col(text_col)
    new = F.transform(F.col(pieces), lambda x, i: F.when(i % 2 == 1, surrogate(type_of(x), x, draws)).otherwise(x))
    changed = F.when(F.size(pieces) > 1, F.array_join(new, "")).otherwise(text)
    columns = [changed.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    number = F.coalesce(F.floor(F.size(pieces) / 2), F.lit(0)).cast("long")
    return docs.withColumn(pieces, cut(text)).select(*columns, *([number.alias(counts)] if counts else []))


def key_of(spark: SparkSession) -> str:
    """The secret of the session, which production sets in relata.pii.key; without it the public key of tests, with a warning."""
    key = spark.conf.get("relata.pii.key", None)
    if key is None:
        warnings.warn("relata.pii.key is not set: surrogates are made with a public key and can be guessed back", stacklevel=2)
    return key or TEST_KEY


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rewrite(docs, key_of(spark), counts="n_entities")
