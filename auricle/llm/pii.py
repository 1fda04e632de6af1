"""Find personal information in free text and replace it with typed placeholders.

One Aho-Corasick pass over a text finds anchors of a few classes: at-signs and
schemes, telephone and identifier words, labels and verbs of addresses, types
of streets, titles, sign-offs, labels, relations and roles of people. At each
anchor a deterministic local parser expands to the boundaries of the item, at
most to the end of the sentence, and validates its form (international account
numbers also by their check digits). Overlaps are resolved by kind, then by start and length.

Defined results: null stays null and gives no finding; empty and blank texts
stay as they are; an item that occurs twice is replaced at both places and
reported once; names of acts are no private people; texts of any length are
scanned whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auricle.llm.tokens import spread

PLACEHOLDER = {
    "email": "<EMAIL>",
    "phone": "<PHONE>",
    "id_number": "<ID_NUMBER>",
    "address": "<ADDRESS>",
    "person_name": "<PERSON>",
}

# Words and marks by class of anchor, lower case (fixed values).
AT_MARKS = ["@", "(at)", "[at]", "{at}", " at "]
PHONE_WORDS = [
    "tel", "tél", "phone", "whatsapp", "call", "ring", "handy", "mobil", "mobile", "telefon", "telefone", "telephone", "teléfono", "telefono", "téléphone",
    "ruf", "rufen", "appelez", "llama", "llamar", "ligue", "ligar", "fon", "телефон", "тел", "звоните", "позвоните", "電話", "fax", "móvil", "portable", "cell", "sms", "signal",
]
PHONE_MARKS = ["+", "(0", "(2", "00", "0", "1-", "1 ("]
ID_WORDS = [
    "ssn", "social security number", "tax id", "passport", "driving licence", "driver's license", "driver’s license", "driver's licence",
    "id card", "id number", "id no", "ni number", "national insurance number", "nif", "dni", "nie", "steuer-id", "steuer-idnr", "steueridentifikationsnummer",
    "sozialversicherungsnummer", "ausweis-nr", "ausweisnummer", "personalausweis", "reisepass", "sécurité sociale", "carte d’identité", "carte d'identité",
    "passeport", "numéro fiscal", "pasaporte", "seguridad social", "cpf", "cartão de cidadão", "passaporte", "iban", "個人番号", "マイナンバー", "旅券番号", "免許証番号",
    "инн", "паспорт", "снилс",
]
# Labels before an address, and verbs or nouns of living, visiting and sending before a preposition.
ADDRESS_LABELS = [
    "address", "anschrift", "adresse", "dirección", "direccion", "endereço", "morada", "indirizzo", "送り先", "住所", "адрес", "адресу", "доставка", "visit us", "find us", "venue",
]
ADDRESS_VERBS = [
    "live", "lives", "living", "send", "sent", "ship", "ships", "shipped", "deliver", "delivered", "mail", "mailed", "post", "posted", "moved", "pressing", "disc", "record", "tape", "parcel", "load-in", "meet",
    "wohne", "wohnt", "wohnen", "lieferung", "schick", "schicken", "platte", "paket", "habite", "habitons", "envoyez", "envoyer", "disque", "colis", "vivo", "vive", "envía", "enviar", "disco", "paquete",
    "moro", "mora", "envie", "pacote", "живу", "живёт", "живет", "отправьте", "диск", "пластинку", "посылку",
]
_TO_PLACE = re.compile(r"(?:[ \t](?!\d)[\w’']+){0,6}?[ \t](?:at|to|in|an|au|à|a|en|na|no|em|para|по|на|в)\b[ \t]+|[ \t]+(?=[A-ZÄÖÜА-ЯЁ\d])|[ \t]*[:：,-][ \t]*", re.I)
_GAP = re.compile(r"[ \t:：,]*")
STREET_WORDS = [
    "street", "st", "road", "rd", "avenue", "ave", "drive", "lane", "ln", "close", "row", "court", "way", "place", "square", "sq", "terrace", "boulevard", "blvd", "hill", "walk", "crescent", "mews",
]
STREET_ENDS = ["straße", "strasse", "gasse", "platz", "allee", "ufer", "damm", "chaussee", "weg", "ring", "steig", "str."]
STREET_STARTS = [
    "rue", "quai", "impasse", "allée", "chemin", "calle", "plaza", "avenida", "paseo", "camino", "ronda", "rua", "travessa", "praça", "largo", "alameda", "ул.", "улица", "просп.", "проспект", "пер.", "переулок", "наб.", "набережная",
]
TITLES = [
    "mr", "mrs", "ms", "miss", "mx", "dr", "prof", "professor", "herr", "herrn", "frau", "mme", "mlle", "madame", "monsieur", "sr", "sra", "srta", "señor", "señora", "don", "doña", "dona", "dra", "senhor", "senhora",
    "госпожа", "господин", "г-н", "г-жа",
]
SIGN_OFFS = [
    "signed", "regards", "wishes", "sincerely", "yours", "cheers", "love", "thanks", "gruß", "grüße", "grüßen", "gruss", "cordialement", "amicalement", "bien à vous", "amitiés", "saludo", "saludos", "atentamente",
    "abrazo", "cumprimentos", "abraço", "obrigado", "obrigada", "уважением", "приветом", "спасибо",
]
NAME_LABELS = [
    "cc", "attn", "name", "contact", "contact person", "kontakt", "ansprechpartner", "ansprechpartnerin", "contacto", "contato", "contatto", "nom", "nombre", "nome", "responsable", "担当", "氏名", "контакт", "имя", "from", "to",
    "спросить", "спросите", "менеджер", "manager", "agent", "driver", "guest list", "guest", "guests", "reservation",
]
# Words that lead straight to a name: asking, booking and thanking for someone.
ASKING = [
    "ask for", "asked for", "speak to", "speak with", "talk to", "booked through", "booked by", "booked via", "thanks to", "call for", "fragen sie nach", "bitte an", "demander", "demandez", "parler à", "preguntar por", "pregunte por",
    "pregunta por", "hablar con", "perguntar por", "pergunte por", "falar com", "спросить", "спросите", "звать", "my name is", "ich heiße", "je m’appelle", "je m'appelle", "me llamo", "meu nome é", "меня зовут",
]
RELATIONS = [
    "neighbour", "neighbor", "friend", "brother", "sister", "colleague", "cousin", "uncle", "aunt", "wife", "husband", "flatmate", "roommate", "boss", "nachbar", "nachbarin", "freund", "freundin", "bruder", "schwester", "kollege", "kollegin",
    "voisin", "voisine", "ami", "amie", "frère", "sœur", "collègue", "vecino", "vecina", "amigo", "amiga", "hermano", "hermana", "vizinho", "vizinha", "irmão", "irmã", "сосед", "соседка", "друг", "подруга", "брат", "сестра", "коллега",
]
OWNERS = {"my", "our", "his", "her", "their", "mein", "meine", "meinem", "meiner", "unser", "unsere", "mon", "ma", "notre", "mi", "nuestro", "nuestra", "meu", "minha", "nosso", "nossa", "o", "a", "мой", "моя", "наш", "наша"}
ROLES = [
    "manager", "agent", "promoter", "booker", "engineer", "technician", "driver", "photographer", "accountant", "lawyer", "assistant", "coordinator", "merch", "security", "stage hand", "publicist", "veranstalter", "veranstalterin", "technikerin",
    "techniker", "gérant", "régisseur", "régisseuse", "mánager", "representante", "gerente", "agente", "producer’s assistant", "менеджер", "директор", "агент",
]
HONORIFIC_ENDS = ["さん", "様", "氏"]
#: A word for the writer, before which a full name at the head of a sentence is a person who does something to or for them.
SELF_WORDS = ["my", "me", "our", "us", "mir", "uns", "mich", "m’a", "m'a", "nous a", "мне", "нам", "me ha", "nos ha"]
# Words of organisations and releases, which are no parts of people's names.
NOT_NAMES = set(
    "records office booking bookings agency management music press team label studio studios gmbh ltd inc llc verlag festival club bar radio box orchestra ensemble collective quartet quintet trio brothers sisters project band "
    "various artists ep lp vol the and dj mc street road avenue lane hi hello dear all everyone side".split()
)


NOT_NAMES.update(w for cue in SIGN_OFFS + NAME_LABELS + PHONE_WORDS for w in cue.split() if len(w) > 3)
#: Words after which a street may be any words in capitals before a number.
LOOSE = re.compile(r"wohn|schick|lieferung|platte|paket|anschrift|adresse|address", re.I)


def _automaton() -> ahocorasick.Automaton:
    classes = (
        ("at", AT_MARKS), ("phone", PHONE_WORDS + PHONE_MARKS), ("id", ID_WORDS), ("place", ADDRESS_LABELS + ADDRESS_VERBS), ("street", STREET_WORDS), ("street_end", STREET_ENDS), ("street_start", STREET_STARTS),
        ("title", TITLES), ("sign", SIGN_OFFS), ("label", NAME_LABELS), ("ask", ASKING), ("relation", RELATIONS), ("role", ROLES), ("honorific", HONORIFIC_ENDS), ("self", SELF_WORDS),
    )
    found: dict[str, list[str]] = {}
    for kind, cues in classes:
        for cue in cues:
            found.setdefault(cue, []).append(kind)
    out = ahocorasick.Automaton()
    for cue, kinds in found.items():
        out.add_word(cue, (len(cue), tuple(kinds)))
    out.make_automaton()
    return out


def _lower(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Indexed:
    """A text with the places that parsers look back or ahead for, each found once, so that a text is scanned in linear time."""

    _MARKS = {
        "border": re.compile(r"[.!?\n\r|;:/—>#]"),
        "field": re.compile(r"[\n\r|;!?]"),
        "number": re.compile(r"[\d+(\n]"),
        "end": re.compile(r"[.!?;|](?=\s+[A-ZÀ-ÖØ-ÞА-ЯЁ])"),
        "capital": re.compile(r"(?<![\w\-’'])[A-ZÀ-ÖØ-ÞŁŚŽČŠА-ЯЁ]"),
        "street": re.compile(r"(?<![\w.,:'’/-])\d+(?:/\d+)?(?: ?[A-Za-z])?,? "),
        "street_end": re.compile(r"(?<![\w-])[A-ZÄÖÜ]"),
        "street_start": re.compile(r"(?<![\w.,:'’/-])\d|(?<![\w-])[A-ZА-ЯЁ〒]|(?<!\w)(?:ул|пр|наб|пер)"),
    }

    def __init__(self, text: str):
        self.text, self.low = text, _lower(text)
        self._places: dict[str, list[int]] = {}

    def places(self, mark: str) -> list[int]:
        if mark not in self._places:
            self._places[mark] = [m.start() for m in self._MARKS[mark].finditer(self.text)]
        return self._places[mark]

    def before(self, mark: str, i: int, n: int = 1) -> list[int]:
        """The last ``n`` places before ``i``, the nearest first."""
        at = bisect_left(self.places(mark), i)
        return self.places(mark)[max(0, at - n) : at][::-1]

    def after(self, mark: str, i: int) -> int:
        at = bisect_left(self.places(mark), i)
        return self.places(mark)[at] if at < len(self.places(mark)) else len(self.text)

    def sentence(self, i: int) -> int:
        """Where the sentence or field of ``i`` begins; a point after one capital is no border."""
        text = self.text
        while True:
            cut = next(iter(self.before("border", i)), -1)
            if cut < 0 or text[cut] != "." or not (cut and text[cut - 1].isupper() and (cut == 1 or not text[cut - 2].isalpha())):
                return cut + 1
            i = cut


# --- mail ------------------------------------------------------------------------

_LOCAL_END = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]*[A-Za-z0-9])?$|[A-Za-z0-9]$")
_DOT = r"(?:\.| ?[\[({]dot[\])}] ?| dot )"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,}}", re.I)


def _mail(text: str, i: int, j: int) -> tuple[int, int] | None:
    """Mail address around the at-sign text[i:j]."""
    cue = text[i:j]
    left = i
    if left and text[left - 1] == " " and cue != " at ":
        left -= 1
    start = left
    while start and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
        start -= 1
    while start < left and not text[start].isalnum():
        start += 1
    right = j + (text[j : j + 1] == " " and cue != " at ")
    if start == left or not text[left - 1].isalnum() or (left < i) != (right > j) and cue == "@":
        return None
    m = _DOMAIN.match(text, right)
    if not m or cue == " at " and " dot " not in m.group().lower():
        return None
    return start, m.end()


# --- telephone ---------------------------------------------------------------------

_SHAPES = [
    r"(?:\+1[ .\-]?|1[ .\-]|001[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-]?)\d{3}[ .\-]?\d{4}",
    r"(?:(?:\+|00)\d{1,3}|\((?:\+|00)\d{1,3}\))[ .\-/]*(?:\(0\)[ .\-]?)?(?:\(\d{1,4}\)[ .\-]?)?\d(?:[ .\-/]{0,3}\d){5,11}",
    r"\(?0\d{1,4}\)?(?: ?[/\-.] ?| )?\d(?:[ .\-]?\d){5,9}",
    r"[89]\d{2}[ .\-]?\d{2,3}[ .\-]?\d{3,4}",
    r"8[ \-]?\(?\d{3}\)?[ \-]?\d{3}[ \-]?\d{2}[ \-]?\d{2}",
]
_PHONE = re.compile("|".join(f"(?:{s})" for s in _SHAPES))
#: Without a cue before it, only a number that is written as one counts.
_PLAIN = re.compile(
    r"(?:\+\d{1,3}|00\d{2}|\(\+?\d{2,4}\)|\(0\d{1,4}\))[ .\-/]*\(?\d[\d ().\-/]{5,}\d"
    r"|(?:1[ .\-])?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\- ]\d{4}"
    r"|0\d{2} \d{4}[ \-]?\d{4}|0\d[ .]\d\d(?:[ .]\d\d){3}|0\d-\d{4}-\d{4}|0\d{2,4}(?: ?[/\-] ?| )\d{5}[ \-]?\d{3}|0\d{3} \d{4} \d{3}"
)


#: A code in brackets, whose number begins at the bracket.
_AREA = re.compile(r"\+?\d{1,5}\)")


def _edge(text: str, i: int, j: int) -> bool:
    """Nothing numeric touches text[i:j]."""
    before, after = text[max(0, i - 2) : i], text[j : j + 2]
    return not (before[-1:].isalnum() and before[-1:].isascii() or re.match(r"\d[\-./]$", before) or re.match(r"[\-./]?\d", after) or after[:1].isalpha() and after[:1].isascii())


def _phone(text: str, i: int, cued: bool) -> tuple[int, int] | None:
    m = (_PHONE if cued else _PLAIN).match(text, i)
    if not m:
        return None
    end = m.end()
    if not 8 <= sum(c.isdigit() for c in m.group()) <= 15 or not _edge(text, i, end):
        return None
    return i, end


# --- identity numbers ----------------------------------------------------------------

_TO_ID = re.compile(r"(?:\s*(?:is|lautet|est|es|é|n[°ºo]\.?|nr\.?|no\.?|number|nummer|[:：(#.]))*\s*", re.I)
_ID = re.compile(r"(?:[A-Z]{1,3} ?)?\d[0-9A-Z]*(?:[ .\-/]?[0-9]+[A-Z]{0,2}\b|[ .\-/][A-Z]{1,2}\b|[ .\-/][A-Z]{1,3}\d+)*|[A-Z]\d{5,}[A-Z]{0,3}")


_IBAN = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def _account(text: str) -> bool:
    """The check digits of an international account number."""
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def _accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers need no word before them, as their check digits tell them."""
    for m in _IBAN.finditer(text):
        if _account(m.group()):
            yield m.start(), m.end()


def _identity(text: str, j: int) -> tuple[int, int] | None:
    at = _TO_ID.match(text, j).end()
    m = _IBAN.match(text, at) or _ID.match(text, at)
    if not m or sum(c.isdigit() for c in m.group()) < 6:
        return None
    return at, m.end()


# --- addresses -------------------------------------------------------------------------

_W = r"(?:(?:St|Mt|ST|MT|[NSEW])\.|[^\W\d_a-z][\w’'\-]*)"
_TYPE = r"(?i:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Lane|Ln|Close|Row|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Hill|Walk|Crescent|Mews)\b\.?"
_UNIT = r"(?:,? (?i:Unit|Apt\.?|Apartment|Flat|Suite|Ste\.?|#) ?[\w\-]+)?"
_TOWN = r"[^\W\d_][^\W\d_’'\-]*(?:[ \-’'][^\W\d_]+){0,4}?"
_END = r"(?=[.;|/,\n]|\s*$|  | [|/])"
_MIXED = r"(?-i:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’']+)"
_SMALL = r"(?:am|an|der|im|bei|de|del|des|du|la|le|les|sur|sous|el|do|da|dos|das|on|of|sea)"
#: Words in capitals with small ones between them; a town in capitals only ends where the sentence or field does.
_PLACE = rf"(?:{_MIXED}(?:[ \-](?:{_SMALL}[ \-]){{0,2}}{_MIXED})*(?!\w)|{_TOWN}{_END})"
_ADDRESS = [
    # number first, street type last; unit, town and postcode
    re.compile(
        rf"\d+(?:/\d+)? ?[A-Za-z]?\b,? (?:{_W} ){{1,5}}{_TYPE}{_UNIT}(?:,? {_TOWN},? (?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}|[A-Z]{{2}} \d{{5}}(?:-\d{{4}})?|\d{{5}})\b)?"
    ),
    # number first, street type next
    re.compile(
        rf"\d+(?: ?(?:bis|ter|[a-z])\b)?,? (?:rue|avenue|quai|impasse|boulevard|place|allée|chemin|route|cours)\b(?:(?: (?:{_SMALL}|aux?|et|à)(?!\w)|[ ’'](?:[ld][’'])?{_MIXED}(?:-{_MIXED})*(?!\w)){{1,7}}(?:, \d{{5}} {_PLACE})?|(?: (?!\d)[\w’'\-]+){{1,6}}?(?:, \d{{5}} {_PLACE}|{_END}))",
        re.I,
    ),
    # street word ends in a type, number after it
    re.compile(rf"(?:[^\W\d_]+[ \-](?=[A-ZÄÖÜ])[^\W\d_]*|(?=[A-ZÄÖÜ])[^\W\d_]+?)(?i:straße|strasse|gasse|weg|platz|allee|ufer|damm|ring|str\.|steig|chaussee) \d+ ?[a-z]?\b(?:, \d{{5}} {_PLACE})?"),
    # other street names before a number, with postcode and town
    re.compile(rf"(?:[A-ZÄÖÜ][\wäöüß\-]*\.? ){{1,4}}\d+ ?[a-z]?\b(?:, \d{{5}} {_PLACE})?"),
    # street type first, number after the name
    re.compile(
        rf"(?:Calle|Plaza|Avenida|Paseo|Camino|Ronda|Rua|Travessa|Praça|Largo|Alameda|C/)\b(?: (?!\d)[^\W\d_][\w’'\-]*){{1,5}}?,? (?:n[º°o]\.? ?)?\d+[A-Z]?\b(?:, \d+[º°ª]\.? ?[A-Za-z]+)?(?:, \d{{4,5}}(?:-\d{{3}})? {_PLACE})?",
        re.I,
    ),
    re.compile(r"(?:〒?\d{3}-\d{4} ?)?[぀-ヿ一-鿿]{2,}?[市区町村郡県都府][぀-ヿ一-鿿]{1,}?\d+(?:[-－]\d+){1,3}(?: ?[぀-ヿ一-鿿]*\d+号室?)?"),
    re.compile(
        rf"(?:\d{{6}}, )?(?:г\. ?[А-ЯЁ][\w\-]+, )?(?:ул|улица|пр|просп|проспект|пер|переулок|наб|набережная|бульвар|пл|площадь|шоссе)\b\.? ?[А-ЯЁ0-9][\w\-]*(?: [А-ЯЁ][\w\-]*){{0,3}},? (?:д\.? ?|дом )?\d+[а-яА-Я]?(?:/\d+)?(?:, ?(?:к|корп|стр)\.? ?\d+)?(?:, ?(?:кв|квартира|оф)\.? ?\d+)?(?:, \d{{5,6}}(?: {_TOWN})?|, (?:г\. ?)?{_TOWN}(?:, \d{{5,6}})?(?=[.;|/\n]|\s*$|  | [|/]))?"
    ),
]


#: The form that a street word of each class belongs to.
_FORMS = {"street": [0], "street_end": [2], "street_start": [1, 4, 6]}
#: Words of an address before its street word, at most.
_WORDS = 8


#: Words of clauses, which no street holds.
_CLAUSE = re.compile(r"(?i)\b(?:and|then|the|but|while|because|was|were|is|are)\b")


def _trim_end(text: str, end: int) -> int:
    while text[end - 1] in " ," or text[end - 1] == "." and text[end : end + 1] not in (".", ",", ";"):
        end -= 1
    return end


def _address(text: str, j: int, loose: bool) -> tuple[int, int] | None:
    """Address that begins at ``j``; names without a word for a street need a postcode unless ``loose``."""
    ends = [m.end() for n, form in enumerate(_ADDRESS) if (m := form.match(text, j)) and (n != 3 or loose or re.search(r", \d{5} ", m.group()))]
    best = max(ends, default=None)
    return None if best is None else (j, _trim_end(text, best))


def _address_around(t: Indexed, kind: str, i: int, j: int) -> tuple[int, int] | None:
    """Address whose street word is text[i:j]; without a word that introduces it, it needs a house number, and all its words capitals."""
    low = next(iter(t.before("field", i)), -1)
    for start in t.before(kind, i + 1, _WORDS):
        for form in _FORMS[kind] if start > low else []:
            got = _ADDRESS[form].match(t.text, start)
            if got and not _CLAUSE.search(got.group()) and got.end() >= j and (kind != "street_end" or re.search(r"\d{5} ", got.group())):
                return start, _trim_end(t.text, got.end())
    return None


# --- names ---------------------------------------------------------------------------------

_TITLE = re.compile(r"[:：]?(?:\s*(?:Dr|Ms|Mr|Mrs|Prof|Mme|Mlle|Frau|Herr|Herrn|Sra|Sr|Dra|Dona|M(?=\. [A-ZÀ-ÖØ-Þ]\w+ [A-ZÀ-ÖØ-Þ]\w+))\b\.?)*\s*(?:la |el |a |o )?(?:\s*(?:Sra|Sr|Dra|Dr|Ms|Mr|Mrs)\b\.?)*\s*")
_N = r"[A-ZÀ-ÖØ-ÞŁŚŽČŠА-ЯЁ][\wà-öø-ÿ’'а-яё]*"
_FULL = rf"{_N}(?:-{_N})?(?: [A-ZА-Я]\.(?: [A-ZА-Я]\.)?)?(?: (?:de|van|von|da|del|di|le|la|van der|van den))? {_N}(?:-{_N})?"
_LAST_FIRST = rf"{_N}(?:-{_N})?, {_N}(?:-{_N})?(?: [A-ZА-Я]\.)?"
_INITIAL = rf"[A-ZА-ЯЁ]\.(?:[ \-]?[A-ZА-ЯЁ]\.)? ?{_N}(?:-{_N})?|{_N}(?:-{_N})?, [A-ZА-ЯЁ]\."
_NAME = re.compile(rf"{_LAST_FIRST}|{_INITIAL}|{_FULL}")
_CJK_NAME = re.compile(r"[一-鿿]{1,4}[ 　]?[一-鿿぀-ヿ]{1,4}(?=[。、\s.|/;]|$)")

_TITLE_WORD = re.compile(rf"\.?(?:\s+(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\b\.?)*\s+", re.I)
_SURNAME = re.compile(rf"{_N}(?:-{_N})?")


def _is_name(text: str) -> bool:
    """No part is a word of organisations, and none is in lower case but particles."""
    return not any(t in NOT_NAMES for t in re.split(r"[\s,.\-]+", text.lower()) if t)


def _name(text: str, at: int, single: bool = False) -> tuple[int, int] | None:
    """Name at ``at``, titles before it left out; after a title a surname alone counts."""
    start = _TITLE.match(text, at).end()
    m = _NAME.match(text, start) or _CJK_NAME.match(text, start) or (_SURNAME.match(text, start) if single or start > at and text[at:start].strip() else None)
    return (start, m.end()) if m and _is_name(m.group()) else None


def _name_before(t: Indexed, i: int) -> tuple[int, int] | None:
    """Name that ends at ``i``."""
    text, low = t.text, t.sentence(i)
    for k in t.before("capital", i, _WORDS)[::-1]:
        m = _NAME.match(text, k, i) if k >= low else None
        if m and m.end() == i and _is_name(m.group()):
            lead = _TITLE.match(text, k, i).end()
            return (lead if lead > k and _NAME.fullmatch(text, lead, i) else k), i
    m = re.compile(r"[一-鿿]{1,4}[ 　]?[一-鿿぀-ヿ]{0,4}$").search(text, max(low, i - 9), i)
    return (m.start(), i) if m else None


_COLON = re.compile(r"(?:\s+(?:is|ist|est|es|é))?\s*[:：]\s*|\s+[-–—]\s+")
_AFTER_SIGN = re.compile(r"(?:\s+(?:from|von|de|от))?\s*[,，:：]?\s*(?:[-–—]\s*)?")
_BEFORE_ROLE = re.compile(r"(?:,\s|\(\s?)(?:[^\W\d_]+\s){0,2}$")
_TO_NAME = re.compile(r"[:：]?\s+|[:：]")
_DOES = re.compile(rf"({_FULL})((?: [^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁ][\w’']*){{1,3}} )$")


def _person(t: Indexed, kind: str, i: int, j: int) -> tuple[int, int] | None:
    """Name at an anchor text[i:j] of a class of people; where all letters are capitals, only marks tell names."""
    text, low = t.text, t.low
    if text[i:j].isupper() and (kind in ("relation", "role", "self") or kind == "title" and text[j : j + 1] != "."):
        return None
    if kind == "title":
        m = _TITLE_WORD.match(text, j)
        return _name(text, m.end(), single=True) if m and text[i].isupper() and (text[j : j + 1] == "." or text[j : j + 1] == " ") else None
    if kind == "sign":
        m = _AFTER_SIGN.match(text, j)
        return _name(text, m.end()) if m.end() > j and re.search(r"[,，:：\n]", m.group()) else None
    if kind == "label":
        m = _COLON.match(text, j)
        return _name(text, m.end()) if m else None
    if kind == "ask":
        m = _TO_NAME.match(text, j)
        return _name(text, m.end()) if m else None
    if kind == "relation":
        owner = re.search(r"([^\W\d_]+)\s$", low[max(0, i - 20) : i])
        m = re.compile(r",?\s+").match(text, j)
        return _name(text, m.end()) if m and owner and owner.group(1) in OWNERS else None
    if kind == "role":
        before = _BEFORE_ROLE.search(text, max(0, i - 60), i)
        if before:
            end = before.start()
            return _name_before(t, end - (text[end] == "(" and text[end - 1 : end] == " "))
        m = re.compile(r",?\s+").match(text, j)
        return _name(text, m.end()) if m else None
    if kind == "honorific":
        return _name_before(t, i)
    start = re.compile(r"\s*").match(text, t.sentence(i)).end()
    m = _DOES.match(text, start, i)
    return (start, m.end(1)) if m and _is_name(m.group(1)) else None


# --- all together ----------------------------------------------------------------------------

_SPECIFIC = {"email": 0, "id_number": 1, "address": 2, "phone": 3, "person_name": 4}


_PEOPLE = {"title", "sign", "label", "ask", "relation", "role", "honorific", "self"}


def _word(low: str, i: int, j: int) -> bool:
    """Nothing of a word touches low[i:j]."""
    return not (low[i].isalpha() and i > 0 and (low[i - 1].isalnum())) and not (low[j - 1].isalpha() and low[j : j + 1].isalnum())


def _at_anchor(t: Indexed, kind: str, i: int, j: int, tried: set) -> tuple[int, int, str] | None:
    text, low = t.text, t.low
    if kind == "at":
        got = _mail(text, i, j)
        return (*got, "email") if got else None
    cjk = ord(low[i]) > 0x2E7F
    if kind == "phone":
        if low[i].isdigit() or low[i] in "+(":
            if i and (low[i - 1].isdigit() or low[i - 1] == "+" or low[i - 1] == "(" and _AREA.match(low, i)):
                return None
            at, cued = i, False
        elif low[j - 1].isascii() and low[j : j + 1].isalpha() or low[i - 1 : i].isalpha() and low[i - 1].isascii():
            return None
        else:
            at, cued = min(t.after("number", j), t.after("end", j)), True  # the first number within the sentence
        if (at, cued) in tried:
            return None
        tried.add((at, cued))
        got = _phone(text, at, cued)
        return (*got, "phone") if got else None
    if kind == "street_end":
        got = _address_around(t, kind, i, j) if not low[j : j + 1].isalpha() else None
        return (*got, "address") if got else None
    if not cjk and not _word(low, i, j):
        return None
    if kind == "id":
        got = _identity(text, j)
        return (*got, "id_number") if got else None
    if kind == "place":
        for m in (_TO_PLACE.match(text, j), _GAP.match(text, j)):
            got = _address(text, m.end(), bool(LOOSE.match(low, i))) if m and m.end() > j else None
            if got:
                return (*got, "address")
        return None
    if kind in _FORMS:
        got = _address_around(t, kind, i, j)
        return (*got, "address") if got else None
    got = _person(t, kind, i, j)
    return (*got, "person_name") if got else None


def find(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Disjoint (start, end, kind) in order."""
    t = Indexed(text)
    hits: set[tuple[int, int, str]] = {(i, j, "id_number") for i, j in _accounts(text)}
    tried: set[tuple[int, bool]] = set()
    for end, (size, kinds) in automaton.iter(t.low):
        for kind in kinds:
            got = _at_anchor(t, kind, end - size + 1, end + 1, tried)
            if got and got[0] < got[1]:
                hits.add(got)
    out: list[tuple[int, int, str]] = []
    for hit in sorted(hits, key=lambda h: (_SPECIFIC[h[2]], h[0], -h[1])):
        at = bisect(out, hit)
        if (at == 0 or out[at - 1][1] <= hit[0]) and (at == len(out) or out[at][0] >= hit[1]):
            insort(out, hit)
    for name in {text[i:j] for i, j, kind in out if kind == "person_name" and " " in text[i:j]}:
        i = text.find(name)
        while i >= 0:  # the same name elsewhere in the text
            hit, at = (i, i + len(name), "person_name"), bisect(out, (i, i + len(name), "person_name"))
            free = (at == 0 or out[at - 1][1] <= i) and (at == len(out) or out[at][0] >= hit[1])
            if free and not text[i - 1 : i].isalnum() and not text[hit[1] : hit[1] + 1].isalnum():
                insort(out, hit)
            i = text.find(name, hit[1])
    return out


def _finder(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    automaton = _automaton()
    for batch in batches:
        rows = [
            (doc, kind, text[i:j], i, j)
            for doc, text in zip(batch["doc_id"], batch["text"])
            if text
            for i, j, kind in find(text, automaton)
        ]
        yield pd.DataFrame(rows, columns=["doc_id", "kind", "found", "start", "stop"])


def findings(documents: DataFrame, acts: DataFrame) -> DataFrame:
    """(doc_id, kind, found, start, stop); ``acts`` has one column ``artist`` with names that are no private people."""
    docs = documents.where(F.col("text").isNotNull() & (F.col("text") != ""))
    found = spread(docs.select("doc_id", "text")).mapInPandas(
        _finder, "doc_id long, kind string, found string, start int, stop int"
    )
    names = acts.select(F.lower(F.trim("artist")).alias("act")).where("act != ''").distinct()
    is_act = (F.col("kind") == "person_name") & (F.lower("found") == F.col("act"))
    return found.join(names, is_act, "left_anti")


def act_names(documents: DataFrame, tracks: DataFrame) -> DataFrame:
    return documents.select("artist").unionByName(tracks.select("artist"))


def _redactor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch["text"], batch["spans"]):
            if text is not None and spans is not None and len(spans):
                parts, at = [], 0
                for span in sorted(spans, key=lambda s: s["start"]):
                    parts += [text[at : span["start"]], PLACEHOLDER[span["kind"]]]
                    at = span["stop"]
                text = "".join([*parts, text[at:]])
            texts.append(text)
        yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})


def redact(documents: DataFrame, acts: DataFrame) -> DataFrame:
    """(doc_id, text) with placeholders; documents without findings keep their text."""
    spans = findings(documents, acts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "kind")).alias("spans"))
    joined = documents.select("doc_id", "text").join(spans, "doc_id", "left")
    return joined.mapInPandas(_redactor, "doc_id long, text string")
