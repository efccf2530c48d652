"""Personal information in free text: where it stands, and the text with typed placeholders.

A chain of transducers rewrites a text into a plain form: look-alike letters, full-width
forms and odd blanks become ASCII, invisible characters vanish, spelled-out digits become digits,
and spelled or bracketed "at" and "dot" become @ and a point. Each transducer keeps for every
character of its output the place in the source it came from, so that what the detectors find in
the plain form is mapped back to the exact span of the original.

Everything about one text is decided from that text and the (small, fixed) list of names, in one
pass without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

TYPES = ("EMAIL", "ADDRESS", "ID_NUMBER", "PHONE", "NAME")
_SPANS = "array<struct<start_pos: int, end_pos: int, pii_type: string>>"

# Letters of other scripts that look like Latin ones.
_LOOK_ALIKE = dict(zip("асеорхуіѕјһԁѵѡАВСЕНІЈКМОРЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι", "aceopxyisjhdvwABCEHIJKMOPSTXABEZHIKMNOPTYXoavi"))
# Digits as words, in English, German and Spanish.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "null": "0", "cero": "0", "one": "1", "eins": "1", "uno": "1", "two": "2", "zwei": "2", "zwo": "2", "dos": "2",
    "three": "3", "drei": "3", "tres": "3", "four": "4", "vier": "4", "cuatro": "4", "five": "5", "fünf": "5", "cinco": "5",
    "six": "6", "sechs": "6", "seis": "6", "seven": "7", "sieben": "7", "siete": "7", "eight": "8", "acht": "8", "ocho": "8",
    "nine": "9", "neun": "9", "nueve": "9",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


class Traced:
    """A text and, for each of its characters, the span of the source it stands for (None: the source itself)."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.starts is None else (self.starts[a], self.ends[b - 1])

    def rewrite(self, pattern: re.Pattern, put: Callable[[re.Match], str]) -> Traced:
        """Every match replaced by put(match); each character of a replacement stands for the whole match."""
        pieces, starts, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            new = put(m)
            if new == m[0]:
                continue
            if not pieces and self.starts is None:
                self.starts, self.ends = list(range(len(self.text))), list(range(1, len(self.text) + 1))
            pieces.append(self.text[at : m.start()] + new)
            starts += self.starts[at : m.start()] + [self.starts[m.start()]] * len(new)
            ends += self.ends[at : m.start()] + [self.ends[m.end() - 1]] * len(new)
            at = m.end()
        if not pieces:
            return self
        return Traced("".join(pieces) + self.text[at:], starts + self.starts[at:], ends + self.ends[at:])


def _plain(m: re.Match) -> str:
    c = m[0]
    if c in _INVISIBLE:
        return ""
    if c in _LOOK_ALIKE:
        return _LOOK_ALIKE[c]
    k = unicodedata.normalize("NFKC", c)
    if len(k) == 1 and (ord(k) < 128 or k.isalnum()) and not (c.isalpha() and ord(c) < 0x250) and c not in "ºª":
        return k
    return "-" if unicodedata.category(c) == "Pd" else c


_ODD = re.compile(r"[^\x00-\x7f\u00a1-\u00ac\u00ae-\u024f]")
_WORDS = "|".join(_DIGIT_WORDS)
_SPELLED = re.compile(rf"\b(?:(?:double|triple) )?(?:{_WORDS})(?:[ -]+(?:(?:double|triple) )?(?:{_WORDS})){{5,}}\b", re.I)
_AT_BRACKET = re.compile(r"\s*[\[({<]\s*(?:at|@|arroba|ät)\s*[\])}>]\s*", re.I)
_DOT = r"\s*[\[({<]\s*(?:dot|\.|punkt|punto)\s*[\])}>]\s*"
_DOT_BRACKET = re.compile(_DOT, re.I)
#: whether either of them can match, from the bracket on
_BRACKETED = re.compile(r"[\[({<]\s*(?:at|@|arroba|ät|dot|\.|punkt|punto)\s*[\])}>]", re.I)
_DOTTED_MAIL = re.compile(rf"(?<![\w.+-])[\w+-]+(?:(?:\.|{_DOT})[\w+-]+)*@[\w-]+(?:(?:\.|{_DOT})[\w-]+)+", re.I)


def _digits(m: re.Match) -> str:
    out, times = "", 1
    for w in re.findall(r"\w+", m[0].lower()):
        if w in ("double", "triple"):
            times = 2 if w == "double" else 3
        else:
            out += _DIGIT_WORDS[w] * times
            times = 1
    return out


_DOMAIN_WORDS = re.compile(r"(?<=[\w+-])(\s+(?:at|arroba)\s+|@)([\w-]+(?:\s+(?:dot|punkt|punto)\s+[\w-]+)+)", re.I)
_LOCAL_WORDS = re.compile(r"(?<![\w@.+-])(?:[\w+-]+\s+(?:dot|punkt|punto)\s+)+[\w+-]+$", re.I)
_MAIL_WORDS = re.compile(r"(?<=[\w+-])\s+(?:at|arroba)\s+(?=[\w-]+\s+(?:dot|punkt|punto)\s)|(?<=\w)\s+(?:dot|punkt|punto)\s+(?=[\w-])", re.I)


def plain(text: str, spelled: bool = True, disguised: bool = True) -> Traced:
    """The text after all transducers. spelled, disguised: whether digits, or "dot" as a word of its own, can occur at all."""
    t = Traced(text)
    if not text.isascii():
        t = t.rewrite(_ODD, _plain)
    if spelled:
        t = t.rewrite(_SPELLED, _digits)
    if _BRACKETED.search(t.text):
        if _AT_BRACKET.search(t.text):
            t = t.rewrite(_AT_BRACKET, lambda m: "@").rewrite(_DOT_BRACKET, lambda m: ".")
        # without it bracketed dots, which stand in any host name, count only beside a plain @
        elif mails := [m.span() for m in _DOTTED_MAIL.finditer(t.text)]:
            t = t.rewrite(_DOT_BRACKET, lambda m: "." if any(s <= m.start() < e for s, e in mails) else m[0])
    if disguised:
        # "at" alone is an ordinary word: it counts only before a domain that is spelled with "dot"
        at = []
        for m in _DOMAIN_WORDS.finditer(t.text):
            local = _LOCAL_WORDS.search(t.text, at[-1][1] if at else 0, m.start(1))
            at.append((local.start() if local else m.start(1), m.end(2)))
        if at:
            inside = lambda m: any(s <= m.start() < e for s, e in at)
            t = t.rewrite(_MAIL_WORDS, lambda m: m[0] if not inside(m) else "@" if m[0].strip().lower() in ("at", "arroba") else ".")
    return t


# --- detectors on the plain form -------------------------------------------------------------
_EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])")

_EXT = r"(?:,?[ ]?(?:x|ext\.?|extension|Durchwahl|App\.?)[ ]?\d{1,6})?"
_PHONE = re.compile(
    r"(?<![\w.+/:-])(?:"
    r"\+?1[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"  # North America with country code
    r"|\([2-9]\d{2}\)[ .-]?[2-9]\d{2}[ .-]?\d{4}|[2-9]\d{2}([ .-]?)[2-9]\d{2}\1\d{4}"
    r"|(?:\+|00)44[ ]?(?:\(0\)[ ]?)?\d{2,5}[ -]?\d{3,4}[ -]?\d{3,4}|0\d{2,4}[ ]\d{3,4}[ ]\d{3,4}"  # Britain
    r"|(?:\+|00)49[ ]?(?:\(0\)[ ]?)?\(?\d{2,5}\)?[ /-]?\d{3,8}(?:[ -]\d{1,5})?|0\d{2,5}[/ -]\d{4,9}(?:-\d{1,5})?"  # Germany
    r"|(?:\+|00)34[ ]?[6-9]\d{2}[ ]?\d{2,3}[ ]?\d{2,3}[ ]?\d{0,3}"  # Spain
    r"|\+(?!1\b|44|49|34)[2-9]\d{0,2}(?:[ .-]\(?\d{1,4}\)?){2,5}"
    r"|[2-9]\d{2}-\d{4}"
    rf"){_EXT}(?![\w/-]|[.:]\d)"
)

_ID_SHAPE = (
    r"(?:[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"  # British
    r"|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]"  # Spanish
    r"|[A-Z]{1,2}\d{6,8}|\d{3}-\d{2}-\d{4}|\d{3}[ ]\d{2}[ ]\d{4}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}"
    r"|[CFGHJKLMNPRTVWXYZ][CFGHJKLMNPRTVWXYZ0-9]{8}\d?)"
)
_ID_SURE = re.compile(
    r"(?<![\w.:/-])(?:[A-CEGHJ-PQR-TW-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]|[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[TRWAGMYFPDXBNJZSQVHLCKE]"
    r"|X[A-Z]\d{7}|\d{3}-\d{2}-\d{4}|\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3})(?![\w-]|\.\d)"
)
_ID_LABEL = re.compile(
    r"(?i:\bssn|social[ ]security(?:[ ](?:number|no\.?))?|national[ ]insurance(?:[ ](?:number|no\.?))?|identity[ ](?:number|card)|passport(?:[ ](?:number|no\.?))?|tax[ ](?:number|id|no\.?)|national[ ]id(?:[ ]number)?"
    r"|(?:personal)?ausweis(?:nummer|nr\.?)?|steuer(?:[- ]?id|nummer|identifikationsnummer)|reisepass(?:nummer|nr\.?)?|sozialversicherungsnummer|pasaporte|n[uú]mero[ ]de[ ](?:identidad|pasaporte|identificaci[oó]n)|\b(?:dni|nie|nif|nino)\b|\(id\b|\bid[ ](?:number|card))"
    rf"(?i:[ ]?(?:[:=#]|is|was|no\.?|number|n[.º°]?)?[ ]?[\"']?)({_ID_SHAPE}|\d{{9,11}})(?![\w-]|\.\d)"
)
_ID_FIELD = re.compile(rf'";"({_ID_SHAPE}|\d{{9,11}})";"')

_IBAN = re.compile(r"(?<![\w])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")


def _bank_account(text: str) -> bool:
    """Whether the check digits of an account number hold; it is no number of a person."""
    plain_ = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain_[4:] + plain_[:4])) % 97 == 1


_UNIT = r"(?:(?:Apt|Apartment|Flat|Suite|Unit|APT|FLAT|SUITE|UNIT|Ste|Wohnung|Piso)\.?[ ]?#?[\w-]{1,5},?\s+)?"
_CAP = r"[A-ZÀ-ÖØ-Þ](?:[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+)(?:['-][A-ZÀ-Þ]?[A-Za-zÀ-ÿ]+)?"
_KIND = (
    r"(?:Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Lane|Ln|Court|Ct|Boulevard|Blvd|Place|Pl|Square|Sq|Terrace|Way|Close|Crescent|Highway|Hwy|Parkway|Pkwy"
    r"|STREET|ST|AVENUE|AVE|ROAD|RD|DRIVE|DR|LANE|LN|COURT|CT|BOULEVARD|BLVD|PLACE|PL|SQUARE|TERRACE|WAY|CLOSE|CRESCENT|HIGHWAY)\b\.?"
)
#: kinds that are ordinary words too: they count before a town only
_KIND_NEAR_TOWN = r"(?:Hollow|Row|Walk|Mews|Circle|Cir|Trail|Trl|Loop|Alley|Gardens|Gdns|Gate|Grove|Rise|Quay|Wharf|Bend|Crossing|Pike|Path|Ridge|View|Yard|Park|Green|Hill|Crest|Point|Cove|Glen|Heath|Meadows?)"
_ROMANCE = r"(?:rue|avenue|boulevard|place|quai|chemin|all[ée]e|impasse|cours|via|viale|piazza|corso|Rue|Via|Viale|Piazza|Corso)"
_TOWN_WORD = r"(?!Tel\b|Phone\b|TEL\b)" + _CAP
_TOWN = (
    rf"(?:(?:Port|New|San|Santa|Los|Las|Saint|St\.|Fort|Mount|Lake|North|South|East|West|Upper|Lower|Bad|PORT|NEW|SAN|SANTA|SAINT|FORT|MOUNT|LAKE|BAD)[ ]{_TOWN_WORD}"
    rf"|{_TOWN_WORD}(?:[ ](?:Green|Heights|Park|Hills|Hill|Falls|Springs|City|Beach|Valley|Village|Grove|Ridge|Bay|GREEN|HEIGHTS|PARK|HILLS|HILL|FALLS|SPRINGS|CITY|BEACH|VALLEY|VILLAGE|GROVE|RIDGE|BAY))?)"
)
_ZIP = r"(?:[ ](?:[A-Z]{2}[ ])?\d{5}(?:-\d{4})?(?![\d:-]|\.\d|[ ]?%)|[ ][A-Z]{1,2}\d[A-Z\d]?[ ]\d[A-Z]{2}\b)"
_PLACE = rf"(?:,[ ]?(?:\n|\r\n)?{_UNIT}{_TOWN}{_ZIP}?|,?\s+{_TOWN}{_ZIP})?"
_PLACE_FIRST_ZIP = rf"(?:,?\s+(?:D-)?\d{{5}}[ ]{_TOWN}|,[ ]{_TOWN}{_ZIP}?|,?\s+{_TOWN}{_ZIP})?"
_ADDRESS = re.compile(
    r"(?<![\w.:/-])(?:"
    rf"{_UNIT}\d{{1,5}}[a-zA-Z]?[ ](?:(?:N|S|E|W|North|South|East|West)\.?[ ])?{_CAP}(?:[ ]{_CAP}){{0,2}}[ ]{_KIND}(?:,[ ](?:Apt|Apartment|Flat|Suite|Unit)\.?[ ]?#?\w{{1,5}})?{_PLACE}"
    rf"|{_UNIT}\d{{1,5}}[a-zA-Z]?[ ](?:{_CAP}[ ]){{1,3}}{_KIND_NEAR_TOWN},[ ]{_TOWN}{_ZIP}?"
    rf"|\d{{1,4}}(?:[ ]?(?:bis|ter))?,?[ ]{_ROMANCE}[ ](?:(?:de la|de l['’]|de|du|des|d['’]|della|dei|del|di)[ ]?)*{_CAP}(?:[ -]{_CAP}){{0,3}}{_PLACE_FIRST_ZIP}"
    rf"|{_UNIT}(?:P\.?[ ]?O\.?[ ]?Box|P\.?[ ]?O\.?[ ]?BOX|Postfach|POSTFACH|Apartado(?:[ ]de[ ]Correos)?|APARTADO)[ ]\d{{1,6}}{_PLACE_FIRST_ZIP}"
    rf"|(?:(?:Am|An[ ]der|Auf[ ]der|Im|In[ ]der|Zum|Zur|AM|IM|ZUM|ZUR)[ ])?{_CAP}(?:(?<=straße)|(?<=strasse)|(?<=str\.)|(?<=gasse)|(?<=weg)|(?<=platz)|(?<=allee)|(?<=STRASSE)|(?<=GASSE)|(?<=WEG)|(?<=PLATZ)|(?<=ALLEE))[ ]\d{{1,4}}[ ]?[a-z]?\b{_PLACE_FIRST_ZIP}"
    rf"|(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|CALLE|AVENIDA|PLAZA|PASEO)[ ]?(?:(?:de|del|la|las|los|DE|DEL|LA|LAS|LOS)[ ])*{_CAP}(?:[ ]{_CAP}){{0,2}},?[ ]\d{{1,4}}[a-z]?\b(?:,[ ]\d{{1,2}}[º°ª](?:[ ]?[A-Za-z]\b)?)?{_PLACE_FIRST_ZIP}"
    r")"
)

# names
_PARTICLE = r"(?:(?:de la|de los|van der|van den|van de|von der|de|del|della|di|da|van|von|zu|le|ter|ten|DE LA|DE LOS|VAN DER|VAN DEN|VAN DE|VON DER|DE|DEL|DI|DA|VAN|VON)[ ])"
_PART = r"(?:(?:[OoDdLl]['’])?[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+(?:[-'’][A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ]+)*)"
_LOWER = r"(?:[a-zß-öø-ÿ]['’])?[a-zß-öø-ÿ]{2,}(?:-[a-zß-öø-ÿ]+)*"
_INITIAL = r"(?:[A-ZÀ-ÖØ-Þ]\.)"
# words that never are part of a name although capital or (in lower-case names) beside one
_STOP = (
    "who when and und y for the at on in is was has asked rang confirmed confirmó confirma bestätigt entered sent from with reachable said says that this which might can of to by as or "
    "team desk proxy week night shift day site al zu zum zur bei mit auf level port capture account number phone mail email address we they he she it you your our their its a an der die das den dem ein eine el la los las un una que por con para im am um"
).split()
_NOT = "(?!(?i:" + "|".join(_STOP) + r")\b)"
_FULL = (
    rf"(?:{_PARTICLE}?{_PART},[ ]{_PART}(?:[ ]{_INITIAL})?(?![\w-]|['’](?!s\b))"  # family, given
    rf"|(?:{_PART}|{_INITIAL})[ ](?:{_INITIAL}[ ])*{_PARTICLE}?{_PART}"
    rf"|{_PARTICLE}?{_PART})"
)
_LOW = rf"(?:{_PARTICLE}?{_NOT}{_LOWER},[ ]{_NOT}{_LOWER}|(?:{_NOT}{_LOWER}|[a-z]\.)[ ](?:[a-z]\.[ ])*{_PARTICLE}?{_NOT}{_LOWER})"
_ANY = rf"(?:{_FULL}|{_LOW})"
_TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Herrn?|Frau|Señora?|Señorita|Sra?|Srta|Don|Doña|señora?|señorita)\.?"
_CUES = (
    rf"\b{_TITLE}(?:[ ]Dr\.)?[ ]",
    r"\b(?:[Bb]elongs to|[Rr]eported by|[Oo]wned by|[Ss]igned by|[Aa]pproved by|[Cc]onfirmed by|[Aa]ssigned to|[Ee]scalate to|[Ee]skalieren an|[Tt]hanks to|[Dd]ank an|[Gg]racias a|[Ss]poke (?:to|with)|[Tt]alked to|[Mm]et|[Aa]sk|[Cc]all|[Cc]ontact|[Pp]ing|[Ll]lamar a|[Ll]lame a|[Hh]ablar con|[Ee]scalar a|[Aa]visar a|[Rr]ufen Sie|[Bb]itte|[Gg]emeldet von|[Ll]o notificó|[Nn]otificado por|[Bb]adge holder|[Cc]ardholder) ",
    r"(?:\bOn call this week|\bOn call|\bFrom|\bTo|\bCc|\bAttn|\bContact|\bName|\bOwner|\bReporter|\bAuthor|\bAnalyst|\bVon|\bDe|pasted in chat): ",
    r"\bname=[\"']?",
    r"\"(?:reporter|name|owner|author|analyst|user_name|full_name|contact)\"\s*:\s*\"",
    r"\b[Ll]eaked row: \"",
    r"\b(?:(?:Signed|Regards|Best regards|Kind regards|Best|Cheers|Thanks|Sincerely|Yours)(?:,[ ]|,?\s*\n(?:[->][ ]?)*)|(?:Mit freundlichen Grüßen|Viele Grüße|Beste Grüße|Gruß|Saludos|Un saludo|Atentamente|Saludos cordiales),?(?:[ ]|\s*\n(?:[->][ ]?)*))",
)
_CUED = re.compile("(?:" + "|".join(_CUES) + rf")(?P<name>{_ANY})(?P<more>(?: and | und | y ){_ANY}(?= for| für| por|[.,]|$))?")
#: cues that a capital word alone does not follow as a name unless it is known or what follows speaks for it
_WEAK = re.compile(r"(?i)^(?:met|ask|call|contact|ping|from: |to: |cc: |de: |von: |best|thanks|regards|yours|on call: |name: |owner: |don |doña |spoke|talked)")
_BEFORE = re.compile(rf"(?<![\w.@'’-])(?P<name>{_ANY})(?=[ ](?:<|\()\x00|['’]s account\b|[ ]asked for\b|[ ]logged in\b)")
_TAIL_OK = re.compile(r"\s*(?:[.,;:()<\"\n]|$|when|at|on|and|und|y|rang|who|for|\+|\d|confirmed|bestätigt|confirma|reachable|entered)")


_LOWER_TAIL = re.compile(r"\s*(?:[.,;(<\"\n]|$|when|confirmed|bestätigt|confirma|rang|and|und|y|for|at|al|unter|on|asked|entered|reachable|'s)")

# Names that nothing but their shape and the sentence around them gives away: two words or more that look like a name, none of
# them a word that often is capital for other reasons, and beside them what only people are or do. No further capital word may
# follow, as in titles.
_ROLES = """manager boss colleague coworker co-worker supervisor engineer analyst administrator operator technician developer consultant director officer
ceo cto ciso cfo nurse doctor teacher professor student employee contractor intern tenant customer client patient witness author editor assistant secretary
friend brother sister wife husband son daughter mother father neighbour neighbor predecessor successor deputy chairman chairwoman lawyer accountant
kollege kollegin chef chefin leiter leiterin mitarbeiter mitarbeiterin kunde kundin techniker technikerin
jefe jefa colega ingeniero ingeniera empleado empleada cliente técnico técnica""".split()
_ACTS = """interviewed emailed e-mailed phoned messaged texted hired promoted thanked notified informed invited
accompanied|by report|by note|by mail|by letter|by memo|by patch|by paper|by talk|by summary|by review|by analysis|by written|by sent|by opened|by closed|by filed|by prepared|by
reviewed|by created|by authored|by handled|by led|by forward|this|to forward|it|to hand|this|to hand|it|to handed|over|to speak|to speak|with spoke|to spoke|with talk|to talk|with talked|to talked|with met|with meeting|with call|with interview|with
according|to on|behalf|of hire|is named dear befragte befragten laut geschrieben|von erstellt|von verfasst|von entrevistamos|a según escrito|por enviado|por""".split()
_DOES = """said says wrote writes replied replies answered told thinks thought believes believed agreed agrees disagreed disagrees explained noticed
apologised apologized complained fixed joined resigned retired emailed phoned suggested promised offered sagte schrieb meinte antwortete dijo escribió respondió opina""".split()
_NO_NAME = """the this that these those our my your her his their its an in on at if when while after before each every some no not new old all any both few many most
other such yesterday today tomorrow later then however meanwhile finally also but and or so yet once since because although please thanks hello hi dear we they he she it
you i who what where why how monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december
team group campaign operation project program street road avenue drive lane court room building floor meeting main port version rule sensor node server router switch load balancer proxy gateway firewall database cluster printer scanner laptop phone mail web cloud default policy
san santa saint fort mount lake los angeles hong kong
network security data internet windows linux service desk center centre office department company corporation inc ltd gmbh university college school hospital bank
north south east west central upper lower city town county state united states kingdom incident report alert ticket case class build release shift night day blue red
should would could will can must may might shall has have had is was are were do does did be been being
black white grey gray silver golden dark iron steel storm shadow winter rapid first second third last next der die das den dem ein eine einen kein keine wir sie er es ich
ihr unser mein dein im am um bei mit nach von zu und oder aber wenn nachdem heute gestern montag dienstag mittwoch donnerstag freitag samstag sonntag el la los las un una
su mi tu nuestro nuestra este esta hoy ayer lunes martes miércoles jueves viernes sábado domingo en con por para si cuando""".split()
_PROPER = rf"(?!(?i:{'|'.join(_NO_NAME)})\b){_PART}"
_WHOLE = rf"(?P<name>{_PROPER}[ ](?:{_INITIAL}[ ])*{_PARTICLE}?{_PROPER}(?:[ ]{_PROPER})?)(?![\w@/-])(?![ ][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])"
_AFTER_ROLE = re.compile(rf"(?i:\b(?:{'|'.join(_ROLES)})(?:,|[ ](?:is|was|ist|war|es))?[ ]){_WHOLE}")
_AFTER_ACT = re.compile(rf"(?i:\b(?:{'|'.join(x.replace('|', '[ ]') for x in _ACTS)})[ ]){_WHOLE}")
_BEFORE_DOES = re.compile(rf"(?<![\w.@'’/-]){_WHOLE}(?:,[^,.\n]*,)?[ ](?:{'|'.join(_DOES)})\b")

# Words (in lower case) near which the slower patterns are tried.
_ANCHORS = {
    "digit": list(_DIGIT_WORDS),
    "disguise": ["dot", "punkt", "punto"],
    "mail": ["@"],
    "address": [
        "street", " st", "avenue", " ave", "road", " rd", "drive", " dr", "lane", " ln", "court", " ct", "boulevard", "blvd",
        "place", " pl", "square", " sq", "terrace", " way", " close", "crescent", " hollow,", " row,", " walk,", " mews,",
        " circle,", " cir,", " trail,", " trl,", " loop,", " alley,", " gardens,", " gdns,", " gate,", " grove,", " rise,",
        " quay,", " wharf,", " bend,", " crossing,", " pike,", " path,", " ridge,", " view,", " yard,", " park,", " green,",
        " hill,", " crest,", " point,", " cove,", " glen,", " heath,", " meadow,", " meadows,", "rue ", "quai ", "chemin ",
        "allee ", "allée ", "impasse ", "cours ", "via ", "viale ", "piazza ", "corso ", "highway", "hwy", "parkway", "pkwy",
        "box ", "postfach", "apartado", "straße", "strasse", "str. ", "gasse", "weg ", "platz", "allee", "calle", "c/", "avda",
        "avenida", "plaza", "paseo", "camino"
    ],
    "label": [
        "ssn", "social", "national", "identity", "passport", "tax ", "ausweis", "steuer", "reisepass", "sozialvers", "pasaporte",
        "número", "numero", "dni", "nie", "nif", "nino", "(id", "id n", "id c"
    ],
    "field": ['";"'],
    "cue": [
        "mr.", "mr ", "mrs", "ms.", "ms ", "miss ", "mx", "dr.", "dr ", "prof", "herr", "frau", "señor", "sra", "sr.", "sr ",
        "srta", "don ", "doña ", "belongs to ", "reported by ", "owned by ", "signed by ", "approved by ", "confirmed by ",
        "assigned to ", "escalate to ", "eskalieren an ", "thanks to ", "dank an ", "gracias a ", "spoke ", "talked to ", "met ",
        "ask ", "call ", "contact ", "ping ", "llamar a ", "llame a ", "hablar con ", "escalar a ", "avisar a ", "rufen sie ",
        "bitte ", "gemeldet von ", "lo notificó ", "notificado por ", "badge holder ", "cardholder ", "on call", "from: ", "to: ",
        "cc: ", "attn: ", "contact: ", "name: ", "owner: ", "reporter: ", "author: ", "analyst: ", "von: ", "de: ",
        "pasted in chat: ", "name=", '"reporter"', '"name"', '"owner"', '"author"', '"analyst"', '"user_name"', '"full_name"',
        '"contact"', "leaked row", "signed", "regards", "best", "cheers", "thanks", "sincerely", "yours", "grüßen", "grüße",
        "gruß", "mit freundlichen", "viele gr", "beste gr", "saludos", "un saludo", "atentamente"
    ],
    "role": [f"{x}{y}" for x in _ROLES for y in (" ", ",")],
    "act": [x.replace("|", " ") + " " for x in _ACTS],
    "does": [f" {x}" for x in _DOES],
    "before": ["'s account", "’s account", " asked for", " logged in"],
}


def _blanks(text: str) -> list[int]:
    """Where each run of blanks begins."""
    at = np.flatnonzero(_IS_BLANK[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3001)])
    return at[np.diff(at, prepend=-2) > 1].tolist()


_IS_BLANK = np.array([chr(k).isspace() for k in range(0x3002)])


class _Places:
    """A text and where its blanks stand, to look around places by whole words, however long they are."""

    def __init__(self, text: str):
        self.text = text
        self._blanks: list[int] | None = None

    def around(self, a: int, b: int, before: int, after: int) -> tuple[int, int]:
        """From `before` words before the one at a to `after` words behind the one at b."""
        if self._blanks is None:
            self._blanks = _blanks(self.text)
        k, n = bisect_left(self._blanks, a) - 1 - before, bisect_left(self._blanks, b) + after
        return (self._blanks[k] if k >= 0 else 0), (self._blanks[n] if n < len(self._blanks) else len(self.text))

    def near(self, pattern: re.Pattern, hits: list[tuple[int, int]] | None, before: int, after: int) -> Iterator[re.Match]:
        """Matches in the surroundings of the hits; overlapping surroundings are one.

        before, after: at least as many words as the pattern can have there. Where repetitions in it let a match reach the
        end of its surroundings, they are extended until it ends inside.
        """
        text = self.text
        regions: list[list[int]] = []
        for a, b in hits or ():
            low, high = self.around(a, b, before, after)
            if regions and low <= regions[-1][1]:
                regions[-1][1] = max(regions[-1][1], high)
            else:
                regions.append([low, high])
        at = 0
        for low, high in regions:
            at = max(at, low)
            while at <= high and (m := pattern.search(text, at, high)):
                end = high
                while m.end() >= end - 1 and end < len(text):  # what follows the match must be seen too
                    end = min(len(text), end + 200 + (end - m.start()))
                    m = pattern.match(text, m.start(), end) or m
                    if m.end() < end - 1:
                        break
                yield m
                at = max(m.end(), m.start() + 1)


_TAIL_LONE = re.compile(r"\s+(?:at|al|unter|on site|when|for the|and|und|y)\b|\s*\n?Reply-To|,\s[+(\d]|\s*<|\s*$")


class Detector:
    """Finds personal information in a text, with a list of (name, type) as help."""

    def __init__(self, names: list[tuple[str, str]]):
        self.given = {n.lower() for n, t in names if n and t == "given"}
        self.family = {n.lower() for n, t in names if n and t != "given"}
        listed = sorted(({n for n, _ in names if n} | {n.upper() for n, _ in names if n}), key=len, reverse=True)
        family = [n for n in listed if n.lower() in self.family]
        given = [n for n in listed if n.lower() in self.given]
        either = lambda xs: "(?:" + "|".join(map(re.escape, xs)) + ")" if xs else r"(?!)"
        # a listed family name with what stands around it, or a listed given name before a name-like word
        self.listed = re.compile(
            rf"(?<![\w.@/'’-])(?:{either(family)},[ ]{_PART}(?:[ ]{_INITIAL})?|(?:(?:{_PART}|{_INITIAL})[ ])?(?:{_INITIAL}[ ])*{either(family)}|{either(given)}[ ](?:{_INITIAL}[ ])*{_PARTICLE}{_PART}|{either(given)}(?:[ ]{_INITIAL})+[ ]{_PART})(?![\w@/-])"
        )
        low = lambda xs: "(?:" + "|".join(sorted((re.escape(x) for x in xs), key=len, reverse=True)) + ")" if xs else r"(?!)"
        self.lower = re.compile(rf"(?<![\w.@/'’-])(?:{low(self.given)} (?:[a-z]\. )?{low(self.family)}|{low(self.family)}, {low(self.given)})(?![\w@/-])")

        self.anchors = ahocorasick.Automaton()
        for kind, words in {**_ANCHORS, "listed": sorted(self.given | self.family)}.items():
            for w in words:
                kinds = self.anchors.get(w, (len(w), ()))[1]
                self.anchors.add_word(w, (len(w), (*kinds, kind)))
        self.anchors.make_automaton()

    def _known(self, name: str) -> bool:
        parts = [p.strip(" ,").lower() for p in re.split(r",? ", name)]
        return any(p in self.given or p in self.family for p in parts) or name.lower() in self.family

    def _hits(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """Places of the anchor words by kind, from one pass over the text."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out: dict[str, list[tuple[int, int]]] = {}
        for end, (size, kinds) in self.anchors.iter(low):
            for k in kinds:
                out.setdefault(k, []).append((end + 1 - size, end + 1))
        return out

    def _names(self, places: _Places, mails: list[tuple[int, int]], hits: dict) -> Iterator[tuple[int, int]]:
        text = places.text
        for m in places.near(_CUED, hits.get("cue"), 3, 20):
            a, b = m.span("name")
            cue, name = text[m.start() : a], text[a:b]
            lone = " " not in name and "," not in name
            if cue[:5].lower() == "bitte" and not text.startswith(" unter ", b):
                continue
            if _WEAK.match(cue) and not self._known(name) and not (_TAIL_LONE if lone else _TAIL_OK).match(text, b):
                continue
            if name[0].islower() and not name.startswith((
                "de ", "van ", "von ", "di ", "del "
            )) and not self._known(name) and not _LOWER_TAIL.match(text, b):
                continue
            yield a, b
            if m["more"]:
                gap = re.match(r" (?:and|und|y) ", m["more"])
                yield m.start("more") + gap.end(), m.end("more")
        for m in places.near(self.listed, hits.get("listed"), 8, 8):
            yield self._trim(text, *m.span())
        for m in places.near(self.lower, hits.get("listed"), 4, 4):
            yield m.span()
        for pattern, kind, before, after in ((_AFTER_ROLE, "role", 1, 12), (_AFTER_ACT, "act", 4, 12), (_BEFORE_DOES, "does", 16, 1)):
            for m in places.near(pattern, hits.get(kind), before, after):
                yield m.span("name")
        # a name right before a mail address in brackets
        marked, before = text, list(hits.get("before", ()))
        for a, _ in mails:
            if a >= 2 and text[a - 1] in "<(" and text[a - 2] == " ":
                marked = marked[:a] + "\x00" + marked[a + 1 :]
                before.append((a - 1, a))
        for m in _Places(marked).near(_BEFORE, sorted(before), 10, 3):
            yield self._trim(marked, *m.span("name"))

    def _trim(self, text: str, a: int, b: int) -> tuple[int, int]:
        """Without a first word that is a title or opens a sentence."""
        m = re.match(rf"(?:{_TITLE}|Call|Met|From|Thanks|Reported|The|Runbook|Hello|User|Signed|Team|Met|Ask)[ ](?=\S)", text[a:b])
        return (a + m.end(), b) if m else (a, b)

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, type) in code points of the source, in order, not overlapping."""
        if not text:
            return []
        hits = self._hits(text)
        t = plain(text, len(hits.get("digit", ())) > 5, "disguise" in hits or not text.isascii())
        s = t.text
        if s is not text:
            hits = self._hits(s)
        places = _Places(s)
        mails = [m.span() for m in places.near(_EMAIL, hits.get("mail"), 0, 0)]
        found: list[tuple[int, int, str]] = [(a, b, "EMAIL") for a, b in mails]
        found += [(
            m.start(), m.end() - (m[0][-1] == "." and not m[0].endswith("..")), "ADDRESS"
        ) for m in places.near(_ADDRESS, hits.get("address"), 12, 14)]
        found += [(*m.span(1), "ID_NUMBER") for m in places.near(_ID_LABEL, hits.get("label"), 1, 10)]
        found += [(*m.span(1), "ID_NUMBER") for m in places.near(_ID_FIELD, hits.get("field"), 0, 5)]
        found += [(*m.span(), "ID_NUMBER") for m in _ID_SURE.finditer(s)]
        found += [(*m.span(), "PHONE") for m in _PHONE.finditer(s)]
        taken = bytearray(len(s))
        out = []

        def accept(spans: list[tuple[int, int, str]]) -> None:
            for a, b, kind in spans:
                if a < b and not any(taken[a:b]):
                    taken[a:b] = b"\x01" * (b - a)
                    out.append((*t.span(a, b), kind))

        for m in _IBAN.finditer(s):
            if _bank_account(m[0]):
                taken[m.start() : m.end()] = b"\x01" * (m.end() - m.start())
        accept(found)
        for a, b in self._names(places, mails, hits):
            comma = s.find(",", a, b)
            if comma > 0 and any(taken[comma:b]) and not any(taken[a:comma]):
                b = comma  # what follows the comma is an address
            accept([(a, b, "NAME")])
        return sorted(out)


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with [TYPE] in place of each span."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join(out) + text[at:]


def find_pii(df: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, spans (start_pos, end_pos, pii_type) and, if wished, redacted of every row.

    Positions are code points from 0, the end exclusive. names: columns name_text and name_type, a small fixed
    list. Null and empty texts have no spans; texts of any length are read whole; repeated rows are read
    each; an empty table gives no rows.
    """
    ship(df.sparkSession)
    listed = df.sparkSession.sparkContext.broadcast([(r.name_text, r.name_type) for r in names.select("name_text", "name_type").collect()])
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Detector(listed.value)
        for b in batches:
            spans = [detector.find(t) for t in b.text]
            out = pd.DataFrame({"doc_id": b.doc_id, "spans": [[{"start_pos": x, "end_pos": y, "pii_type": k} for x, y, k in s] for s in spans]})
            if with_text:
                out["redacted"] = [redact(t, s) for t, s in zip(b.text, spans)]
            yield out

    return slim.mapInPandas(detect, f"doc_id {dict(slim.dtypes)['doc_id']}, spans {_SPANS}" + ", redacted string" * with_text)
