"""Problem 7: personal data in free text - e-mail and street addresses, phone and identity numbers, names of persons.

Mentions are found on a copy of the text with plain spaces, dashes and digits and without invisible characters, whose positions map
back to the original. One linear pass per pattern over a whole batch, with the same pattern freed of its conditions, tells which
texts a pattern is tried on at all. Each mention can be replaced by a typed placeholder or by a surrogate.

A surrogate is made by a keyed permutation of the mention's own symbols, and by nothing else: neither the text around it nor other
mentions count, so equal mentions stay equal over the whole corpus, different ones different, and who holds the key can take it back.
Symbols stay in their class: digits digits, vowels vowels, consonants consonants, with case, script and accent; separators, country
codes, domain endings and words for kinds of streets stay; a given name becomes another one of its gender. The permutation is one
cycle over all texts of a shape, so none stays as it is; where a result would read as another structure (a word for a kind of street
that wasn't there), it is walked on to the next that doesn't, which keeps it one to one.

Map-only. Results: null, empty and blank texts have no mention and stay as they are; repeated rows are treated alike. Mentions that
differ only in invisible characters, kinds of spaces or the way accents are written are the same mention. One that has no symbol to
exchange gets a placeholder with a keyed number.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.llm.common import map_arrow

KINDS = ("email", "phone", "id_number", "address", "name")

# Common given names of women and men in the languages at hand.
FEMALE = [
    "Ada", "Agnieszka", "Aisha", "Alice", "Amélie", "Amina", "Ana", "Anastasia", "Anna", "Astrid", "Aylin", "Beatriz", "Camille", "Carla", "Carmen",
    "Chiara", "Chloé", "Clara", "Claudia", "Elena", "Elif", "Elise", "Emily", "Emma", "Ewa", "Fatima", "Francesca", "Freya", "Giulia", "Greta",
    "Hanna", "Helena", "Inès", "Ingrid", "Irina", "Isabel", "Jana", "Jelena", "Julia", "Kasia", "Katarina", "Kateryna", "Laura", "Lea", "Leila",
    "Lena", "Leonie", "Lina", "Linnea", "Lotte", "Lucía", "Lucie", "Lucy", "Magda", "Maja", "Manon", "María", "Maria", "Marie", "Marta", "Mei",
    "Mia", "Mira", "Nadia", "Natalia", "Nina", "Noémie", "Olga", "Oksana", "Olivia", "Paula", "Petra", "Pilar", "Priya", "Rosa", "Sara", "Sarah",
    "Sigrid", "Signe", "Sofía", "Sofia", "Sophie", "Svetlana", "Teresa", "Valentina", "Vera", "Yara", "Yasmin", "Yuki", "Zeynep", "Zoé",
]
MALE = [
    "Adam", "Ahmed", "Alejandro", "Alessandro", "Alexander", "Ali", "Andreas", "Andrei", "Anton", "Antonio", "Arjun", "Artem", "Bruno", "Carlos",
    "Daniel", "David", "Diego", "Dmitri", "Duarte", "Eduardo", "Emil", "Emre", "Erik", "Farid", "Felix", "Francisco", "Georg", "Giovanni", "Gustav",
    "Hans", "Hassan", "Henrik", "Hiroshi", "Hugo", "Igor", "Ivan", "Jakob", "Jan", "Javier", "João", "Johan", "Johannes", "John", "Jonas", "José",
    "Juan", "Julien", "Jürgen", "Karim", "Karl", "Kaspar", "Kenji", "Lars", "Leon", "Léo", "Liam", "Lucas", "Luca", "Luis", "Lukas", "Marco",
    "Marek", "Mario", "Martin", "Mateo", "Matteo", "Max", "Mehmet", "Michael", "Miguel", "Mikhail", "Milan", "Mohamed", "Nicolas", "Niels", "Nils",
    "Noah", "Oleg", "Olivier", "Omar", "Oskar", "Pablo", "Paulo", "Pavel", "Pedro", "Peter", "Pierre", "Piotr", "Rafael", "Rajesh", "Raúl", "Sami",
    "Samuel", "Sergei", "Stefan", "Sven", "Théo", "Thomas", "Tomasz", "Viktor", "Yusuf",
]
_GIVEN = {unicodedata.normalize("NFC", n): s for s, names in (("f", FEMALE), ("m", MALE)) for n in names}

_UNUSUAL = {c: " " for c in (*range(0x2000, 0x200B), 0xA0, 0x1680, 0x202F, 0x205F, 0x3000)}
_UNUSUAL |= {c: "-" for c in (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0xFE63, 0xFF0D)}
_UNUSUAL |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿︎️]")

_DOT = r"(?:\.|\s*[\[({]\s*(?:dot|punkt|point|punto|\.)\s*[\])}]\s*|\s+(?:dot|punkt|punto)\s+)"
_AT = r"(?:\s*[\[({]\s*(?:at|@|arroba|ät)\s*[\])}]\s*|@|\s+at\s+(?=[\w-]+\s+(?:dot|punkt|punto)\s))"
EMAIL = re.compile(rf"(?i)(?<![\w.+/:@-])(?:mailto:)?[\w][\w.+%'-]*{_AT}[a-z0-9](?:[\w-]*[a-z0-9])?(?:{_DOT}[a-z0-9](?:[\w-]*[a-z0-9])?)*{_DOT}[a-z]{{2,18}}(?![\w@-])(?!:[\w/])")
_UNITS = r"(?!\s*(?:ms|s|sec|kb|mb|gb|kib|mib|bytes?|px|%|€|\$|usd|eur)\b)"
PHONE = re.compile(
    r"(?<![\w.+/:#-])(?:"
    r"\+\d{1,3}[ .-]?(?:\(0\) ?)?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){6,12}"
    r"|00\d{2,3}[ .-](?:\(0\) ?)?\d{1,4}(?:[ .-]\d{2,4}){1,4}"
    r"|(?:1[ .-])?\([2-9]\d{2}\) ?[2-9]\d{2}[ .-]\d{4}|[2-9]\d{2}\.[2-9]\d{2}\.\d{4}|[2-9]\d{2}-[2-9]\d{2}-\d{4}"
    r"|0\d{2,4} ?/ ?\d{2,4}(?: ?\d{2,4}){1,3}|0[1-9](?:[ .]\d{2}){4}"
    r")(?![\w/-]|\.\d)" + _UNITS
)
# What identity documents are called.
_ID_WORDS = (
    r"passports?(?: (?:no|nr|num|number|id)\b\.?)?|passeport|pasaporte|reisepass(?:nummer)?|(?:personal)?ausweis(?:nummer)?|driver'?s? licen[cs]e|driving licen[cs]e|driver’s licen[cs]e|führerschein(?:nummer)?|permis de conduire|permiso de conducir|carn[eé] de conducir"
    r"|ssn|social security(?: number| no\.?)?|n°? ?de s[ée]curit[ée] sociale|num[ée]ro de s[ée]curit[ée] sociale|sozialversicherungsnummer|rentenversicherungsnummer|seguridad social|national (?:id(?:entity)?|insurance)(?: (?:card|number|no\.?))?|insurance (?:number|no\.?|id)|nino"
    r"|steuer-?id(?:ent)?(?:nr\.?|nummer|entifikationsnummer)?|steuernummer|tax ?(?:payer)? ?(?:id|number|no\.?)|tin|dni|nif|nie|cpf|nir|pesel|personnummer|identity (?:card|number)|id card|carte d['’]identit[ée]|c[ée]dula|curp|matrícula de identidad|licen[cs]e (?:no\.?|number)"
)
ID_NAMED = re.compile(rf"(?<![\w-])(?i:{_ID_WORDS})(?![\w])\s*(?i:(?:no|nr|number|nummer|num|id)\b\.?)?\s*(?i:is|ist|es|est|:|#|=|-)?\s*([A-Z]{{0,3}}\d(?:[ ./-]?[A-Z0-9]){{4,20}}|[A-Z][A-Z0-9]{{7,11}})(?![\w])")
ID_PLAIN = re.compile(
    r"(?<![\w.+/#-])(?:(?P<ssn>\d{3}-\d{2}-\d{4})|(?P<nir>[12] \d{2} (?:0[1-9]|1[0-2]|[2-9]\d) \d{2,3} \d{3} \d{3}(?: \d{2})?)|(?P<dni>\d{8}-?[A-Z])|(?P<nie>[XYZ]-?\d{7}-?[A-Z])|(?P<nino>[A-CEGHJ-PR-TW-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]))(?![\w-]|\.\d)"
)
_NOT_ID = re.compile(r"(?i)(?:\b(?:error|code|order|ticket|build|run|version|checksum|execution|issue|part|serial|sku|ref(?:erence)?|invoice|case)\b\W{0,3}(?:(?:code|no|id|number)\b\W{0,3})?)$")
_CAP = r"[A-ZÀ-ÖØ-Þ][\wà-öø-ÿß’'-]*"
_LINK = r"(?:de |del |de la |de los |de las |du |des |de l['’]|d['’]|la |le |les |l['’]|el |los |las |da |do |dos |das |von |van |am |an der |im |zum |zur )*"
_PLACE = rf"(?:,? ?(?:\d{{1,2}}\s?[ºª°.]\s?[A-Z]?|Apt\.? ?\w+|Apartment \w+|Suite \w+|Unit \w+|Flat \w+|bât\.? \w+))?(?:,\s*(?:\d{{4,5}} )?(?:(?:San|Santa|Saint|St\.|Sankt|Bad|New|Los|Las|La|Le|El|Port|North|South|East|West|Upper|Lower|Great) )?{_CAP}(?: \d{{4,6}}| [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})?)?"
ADDRESS = re.compile(
    rf"(?<![\w/.:@-])(?:(?:{_CAP} (?:House|Cottage|Court|Lodge|Building),\s*)?\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Lane|Ln\.?|Drive|Dr\.?|Close|Court|Ct\.?|Way|Boulevard|Blvd\.?|Place|Pl\.?|Square|Sq\.?|Terrace|Crescent|Gardens|Row|Grove|Mews|Parkway|Highway)(?![\w])(?! (?:View|Map|Test|Config|API|Mode))"
    rf"|\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|chemin|boulevard|bd|place|allée|impasse|quai|route|cours|square|passage|sentier|ruelle) {_LINK}{_CAP}(?:[ -]{_CAP})*"
    rf"|(?:{_CAP}[ -]){{0,2}}(?:[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|graben|steig|pfad|stieg|chaussee)|(?:Straße|Strasse|Str\.|Weg|Gasse|Allee|Platz))\s\d{{1,4}} ?[a-z]?(?![\w])"
    rf"|(?:Calle|C/|C\.|Avenida|Avda\.?|Av\.|Plaza|Pza\.?|Paseo|P\.º|Camino|Carretera|Ronda|Travesía|Rua|Travessa|Via|Viale|Piazza|Corso) ?{_LINK}{_CAP}(?: {_LINK}{_CAP}){{0,4}},? (?:n[º°.] ?)?\d{{1,4}}(?![\w])"
    rf"|(?i:p\.? ?o\.? box|postfach|apartado(?: de correos)?|boîte postale) \d{{1,6}})" + _PLACE
)
_NAME = rf"({_CAP}(?:[ -]{_CAP})?(?: (?:de|del|la|von|van|der|da|dos|di|bin|al|el|le|O['’])){{0,2}} {_CAP})"
NAME_CONTEXT = re.compile(
    rf"(?:\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sra?|Srta|Mme|Mlle|M|Frau|Herrn?|Fr|Hr|Monsieur|Madame|Mademoiselle|Señora?|señora?|Don|Doña|Dona|Sir)\.? |\b(?:[Mm]y name is|I am|[Ii]ch heiße|[Ii]ch bin|[Jj]e m['’]appelle|[Jj]e suis|[Mm]e llamo|[Mm]i nombre es|[Mm]ein Name ist|[Mm]y (?:colleague|manager|boss|coworker|friend|wife|husband)|[Mm]ein(?:e)? Kolleg(?:e|in)|[Mm](?:on|a) coll[èe]gue|[Mm]i (?:colega|compañer[oa])|[Cc]ontact(?:ez)?|[Kk]ontakt:?|[Cc]ontacto:?|client|customer|patient|Kund(?:e|in)|cliente) "
    rf"|(?:client|customer|patient|user|Kunde|Kundin|cliente|name|nombre|nom|Name|contact|owner|assignee)[\"']?\s*:\s*[\"']?|\b(?:[Cc]heers|[Rr]egards|[Kk]ind regards|[Bb]est regards|[Bb]est|[Tt]hanks|[Tt]hank you|[Ss]incerely|[Gg]reetings|[Ss]aludos|[Uu]n saludo|[Aa]tentamente|[Gg]racias|(?:[Vv]iele |[Bb]este |[Ll]iebe |[Mm]it freundlichen )?[Gg]rüßen?|VG|MfG|LG|[Cc]ordialement|[Bb]ien à vous|[Mm]erci|[Aa]mitiés|[Aa]braço|[Oo]brigado),\s+|[—-] )"
    + _NAME
)
_GIVEN_RX = "|".join(sorted(map(re.escape, _GIVEN), key=len, reverse=True))
NAME_GIVEN = re.compile(rf"(?<![\w@.+/#-])((?:{_GIVEN_RX})(?:[ -](?:{_GIVEN_RX}|[A-Z]\.))? (?:(?:de|del|la|von|van|der|da|dos|di|bin|al|el|le) ){{0,2}}{_CAP})(?![\w@]|\.\w)")
# Given names, family names and words around names in scripts other than Latin; mobile numbers of China and Russia.
_CYR = r"[А-ЯЁІЇЄҐ][а-яёіїєґ’'-]+"
_CYR_GIVEN = [
    "Александр", "Александра", "Алексей", "Алёна", "Анастасия", "Андрей", "Анна", "Антон", "Артём", "Борис", "Валентина", "Василий", "Вера",
    "Виктор", "Виктория", "Виталий", "Владимир", "Галина", "Григорий", "Дарья", "Денис", "Дмитрий", "Евгений", "Евгения", "Екатерина", "Елена",
    "Иван", "Игорь", "Илья", "Ирина", "Кирилл", "Константин", "Ксения", "Лариса", "Людмила", "Максим", "Мария", "Марина", "Михаил", "Надежда",
    "Наталья", "Никита", "Николай", "Оксана", "Олег", "Ольга", "Павел", "Пётр", "Полина", "Роман", "Светлана", "Сергей", "София", "Станислав",
    "Татьяна", "Юлия", "Юрий",
]
NAME_CYRILLIC = re.compile(
    rf"(?:(?:[Мм]еня зовут|[Мм]оё имя|[Сс] уважением,|[Кк]оллега|[Гг]оспод(?:ин|жа)|[Гг]-н|[Гг]-жа|[Кк]онтакт:|ФИО:|[Вв]аш[аи]?,)\s+({_CYR}(?: {_CYR}){{1,2}})|(?<!\w)((?:{'|'.join(_CYR_GIVEN)})(?: {_CYR}(?:ович|евич|ична|овна|евна))? {_CYR})|(?<!\w)({_CYR} (?:{'|'.join(_CYR_GIVEN)})(?: {_CYR}(?:ович|евич|ична|овна|евна))))(?!\w)"
)
_HAN_FAMILY = "欧阳|司马|诸葛|上官|[王李张张劉刘陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔣蔡贾賈丁魏薛叶葉阎余潘杜戴夏钟鐘汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文]"
NAME_HAN = re.compile(rf"(?:我叫|我的名字是|名字叫|姓名[:：]\s*|联系人[:：]\s*|聯絡人[:：]\s*|我是(?=(?:{_HAN_FAMILY})[一-鿿]{{1,2}}[，。,.！!\s]))((?:{_HAN_FAMILY})[一-鿿]{{1,2}})|(?:(?<![一-鿿])|(?<=[系给給向和是找请請由与與问問]))((?:{_HAN_FAMILY})[一-鿿]{{1,2}})(?=先生|女士|小姐|老师|老師|经理|經理|医生|醫生)")
NAME_KANA = re.compile(r"(?:私は|名前は|氏名[:：]\s*|担当の)([一-鿿々]{1,3}[ 　]?[一-鿿々ぁ-んァ-ヶー]{1,4}?)(?=です|と申します|[。、,\s]|$)|(?<![一-鿿々])([一-鿿々]{2,3}[ 　]?[一-鿿々]{1,3})(?=さん|様|氏)")
_HANGUL_FAMILY = "[김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허남심노하곽성차주우구민유진지엄]"
NAME_HANGUL = re.compile(rf"(?:저는|제 이름은|이름[:：]|담당자[:：]?)\s*({_HANGUL_FAMILY}[가-힣]{{2}})(?=입니다|이라고|라고|이고|[.,\s]|$)|(?<![가-힣])({_HANGUL_FAMILY}[가-힣]{{2}})(?= ?씨| ?님)")
PHONE_LOCAL = re.compile(r"(?<![\w.+/:#-])(?:(?<!\d)(?P<cn>1[3-9]\d[ -]?\d{4}[ -]?\d{4})|[78][ -]?\(\d{3}\)[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}|8[ -]9\d{2}[ -]\d{3}[ -]\d{2}[ -]\d{2})(?![\w-]|\.\d)")
_PHONE_WORDS = re.compile(r"(?i)(?:电话|電話|手机|手機|联系|聯絡|微信|тел|phone|mobile|call|whatsapp|\btel)")
_WIDE = re.compile(r"[Ͱ-ῼ぀-鿿가-힣]")
# Capitalised words that stand in names of products, places and things.
_NOT_NAME = set(
    [
    "Memory", "Buffer", "Window", "View", "Map", "Street", "Road", "Wizard", "Merge", "Vector", "Store", "Simple", "Node", "Nodes", "Agent",
    "Agents", "Server", "Team", "House", "Close", "Lane", "Drive", "Avenue", "Trigger", "Chain", "Tool", "Tools", "Workflow", "Template", "Queue",
    "Webhook", "Error", "Version", "Build", "Host", "Order", "Checksum", "Execution", "Test", "Record", "Form", "Field", "Key", "Token", "Cloud",
    "Studio", "Code", "Data", "Base", "API", "App", "Apps", "Panel", "Table", "Sheet", "Inc", "Ltd", "GmbH", "Labs", "Support", "Community",
    "Package", "Container", "Docker", "Google", "Microsoft", "Open", "Source", "The", "This", "That", "Our", "My", "Your", "Use", "Set", "Install",
    "Apt",
]
)


def flatten(text: str) -> tuple[str, list[int] | None]:
    """The text with plain spaces, dashes and digits, without invisible characters; positions in the original if they differ."""
    if text.isascii():
        return text, None
    plain = text.translate(_UNUSUAL)
    if not _INVISIBLE.search(plain):
        return plain, None
    at = [i for i, c in enumerate(plain) if not _INVISIBLE.match(c)]
    return "".join(plain[i] for i in at), at


def _linear(pattern: str) -> str:
    """The pattern without look-arounds and word boundaries, for a linear matcher: it matches wherever the pattern does, and more."""
    out, at = [], 0
    while at < len(pattern):
        if re.match(r"\(\?<?[=!]", pattern[at:]):
            depth, held = 0, False
            while True:
                c = pattern[at]
                if c == "\\":
                    at += 1
                elif held:
                    held = c != "]"
                elif c == "[":
                    held = True
                    at += pattern[at + 1 : at + 2] == "]"
                else:
                    depth += (c == "(") - (c == ")")
                at += 1
                if not depth:
                    break
            continue
        c = pattern[at]
        if c == "[":
            end = at + 1 + (pattern[at + 1] == "^")
            end += pattern[end] == "]"
            while pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            out.append(pattern[at : end + 1].replace(r"\w", r"\pL\pN\pM_").replace(r"\d", r"\p{Nd}").replace(r"\s", r"\s\pZ"))
            at = end + 1
            continue
        step = 2 if c == "\\" else 1
        piece = pattern[at : at + step]
        out.append({r"\b": "", r"\w": r"[\pL\pN\pM_]", r"\d": r"\p{Nd}", r"\s": r"[\s\pZ\x{85}\x1c-\x1f]"}.get(piece, piece))
        at += step
    return "".join(out)


def _dni_ok(v: str) -> bool:
    v = v.replace("-", "")
    n = {"X": "0", "Y": "1", "Z": "2"}.get(v[0], v[0]) + v[1:-1]
    return n.isdigit() and "TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] == v[-1]


def mentions(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each mention in order, without overlaps; positions are those of the original text."""
    return next(mentions_of([text]))


def mentions_of(texts: list[str | None]) -> Iterator[list[tuple[int, int, str]]]:
    """The mentions of each text of a batch."""
    flats = [flatten(t) if t and not t.isspace() else ("", None) for t in texts]
    column = pa.array([f for f, _ in flats], pa.large_string())
    asked = [pc.match_substring_regex(column, rx).to_numpy(zero_copy_only=False) for rx in _TRIED]
    some = np.logical_or.reduce(asked) if len(texts) else []
    for i, (t, at) in enumerate(flats):
        yield _mentions(t, at, [a[i] for a in asked]) if some[i] else []


def _mentions(t: str, at: list[int] | None, asked: list[bool]) -> list[tuple[int, int, str]]:
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(t))

    def take(a: int, b: int, kind: str) -> None:
        if not any(taken[a:b]):
            found.append((a, b, kind))
            taken[a:b] = b"\1" * (b - a)

    email, address, named, plain, phone, given, context, local, other = asked
    for m in EMAIL.finditer(t) if email else ():
        a = m.start() + (7 if m[0][:7].lower() == "mailto:" else 0)
        if "://" not in t[max(0, a - 40) : a].rsplit(" ", 1)[-1]:
            take(a, m.end(), "email")
    for m in ADDRESS.finditer(t) if address else ():
        take(*m.span(), "address")
    for m in ID_NAMED.finditer(t) if named else ():
        digits = sum(c.isdigit() for c in m[1])
        if digits >= 5 or digits and re.fullmatch(r"[A-Z0-9]{8,12}", m[1]) or "ausweis" in m[0].lower() and re.fullmatch(r"[A-Z0-9]{9}", m[1]):
            take(*m.span(1), "id_number")
    for m in ID_PLAIN.finditer(t) if plain else ():
        if m["ssn"] and _NOT_ID.search(t[max(0, m.start() - 30) : m.start()]):
            continue
        if (m["dni"] or m["nie"]) and not _dni_ok(m["dni"] or m["nie"]):
            continue
        take(*m.span(), "id_number")
    for m in PHONE.finditer(t) if phone else ():
        if 7 <= sum(c.isdigit() for c in m[0]) <= 15 and not _NOT_ID.search(t[max(0, m.start() - 30) : m.start()]):
            take(*m.span(), "phone")
    for m in PHONE_LOCAL.finditer(t) if local else ():
        lead = t[max(0, m.start() - 30) : m.start()]
        if (not m["cn"] or _PHONE_WORDS.search(lead) or _WIDE.search(lead)) and not _NOT_ID.search(lead):
            take(*m.span(), "phone")
    for rx, tried in ((NAME_GIVEN, given), (NAME_CONTEXT, context)):
        for m in rx.finditer(t) if tried else ():
            words = re.split(r"[ -]", m[1])
            if not _NOT_NAME & set(words) and (rx is NAME_GIVEN or _plausible(m, t)):
                take(*m.span(1), "name")
    if other:
        for rx in (NAME_CYRILLIC, NAME_HAN, NAME_KANA, NAME_HANGUL):
            for m in rx.finditer(t):
                take(*m.span(m.lastindex), "name")
    found.sort()
    return found if at is None else [(at[a], at[b - 1] + 1, k) for a, b, k in found]


# The patterns in the order of `asked`, as the linear matcher sees them.
# An address is written for it by hand: a number before a capital, beside a word for a kind of street, or of a box.
_ADDRESS_TRIED = (
    r"\p{Nd}[A-Za-z]? \p{Lu}|\p{Nd}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|chemin|boulevard|bd|place|allée|impasse|quai|route|cours|square|passage|sentier|ruelle) "
    r"|(?:[sS]traße|[sS]trasse|[sS]tr\.|[wW]eg|[gG]asse|[aA]llee|[pP]latz|ring|damm|ufer|graben|steig|pfad|stieg|chaussee)[\s\pZ\x{85}\x1c-\x1f]\p{Nd}"
    r"|(?:Calle|C/|C\.|Avenida|Avda|Av\.|Plaza|Pza|Paseo|P\.º|Camino|Carretera|Ronda|Travesía|Rua|Travessa|Via|Piazza|Corso).*\p{Nd}|(?i:p\.? ?o\.? box|postfach|apartado|boîte postale)"
)
_TRIED = [_linear(rx.pattern) for rx in (EMAIL,)] + [_ADDRESS_TRIED] + [_linear(rx.pattern) for rx in ( ID_NAMED, ID_PLAIN, PHONE, NAME_GIVEN, NAME_CONTEXT, PHONE_LOCAL)] + [r"[А-яЁёІЇЄҐ]{2} [А-яЁёІЇЄҐ]|[\x{4e00}-\x{9fff}]{2}|[\x{ac00}-\x{d7a3}]{2}"]


def _plausible(m: re.Match, t: str) -> bool:
    """Two words that only the context makes a name: both written like words of a name, the second not the head of a product."""
    first, last = m[1].split(" ")[0], m[1].split(" ")[-1]
    lead = m[0][: -len(m[1])]
    if lead.strip() in ("-", "—"):
        return m.end() >= len(t.rstrip(" .!?)")) and m.start() > 0 and bool(re.fullmatch(rf"{_CAP}", first)) and first in _GIVEN
    return not first.isupper() and not last.isupper() and len(first) > 1 and len(last) > 2 and not re.search(r"[a-z][A-Z]", m[1])


# --- replacement -------------------------------------------------------------------------------------------------------------------

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
# Classes of plain letters and digits; all other letters fall into classes by rule, see _class_of.
_CLASSES = ("0123456789", "aeiou", "bcdfghklmnprstvw", "jqxyz", "AEIOU", "BCDFGHKLMNPRSTVW", "JQXYZ")
_PARTICLES = {"de", "del", "la", "von", "van", "der", "da", "dos", "di", "bin", "al", "el", "le"}
_KEEP_WORDS = re.compile(
    r"(?i)\b(?:street|st|road|rd|avenue|ave|lane|ln|drive|dr|close|court|way|boulevard|place|square|apt|house|rue|chemin|place|allée|impasse|calle|avenida|plaza|paseo|camino|rua|via|de|del|la|du|des|le|les|los|las|von|van|der)\b\.?|(?:straße|strasse|str\.|weg|gasse|allee|platz)"
)


@lru_cache(1 << 16)
def _class_of(c: str) -> tuple[str, int] | None:
    """The class of a symbol and its place in it; null for what isn't exchanged.

    Letters beyond ASCII share a class with those of their row of 128 code points that have the same category and, with an accent, the
    same kind of letter under it; only letters that are written as one sign count.
    """
    for cls in _CLASSES:
        if c in cls:
            return cls, cls.index(c)
    if c.isascii() or unicodedata.category(c) not in ("Lu", "Ll", "Lo", "Nd"):
        return None
    cls = _row_class(ord(c) >> 7, _letter_kind(c))
    return (cls, cls.index(c)) if c in cls and len(cls) > 1 else None


def _letter_kind(c: str) -> tuple[str, bool]:
    return unicodedata.category(c), unicodedata.normalize("NFD", c)[0].lower() in "aeiouyæøœ"


@lru_cache(1 << 12)
def _row_class(row: int, kind: tuple[str, bool]) -> str:
    return "".join(c for c in map(chr, range(row << 7, row + 1 << 7)) if _letter_kind(c) == kind and unicodedata.normalize("NFC", c) == c)


class _Symbols:
    """The symbols of a text that may be exchanged, as digits of a number with a base for each place."""

    def __init__(self, text: str, fixed: tuple[tuple[int, int], ...]):
        frozen = {i for a, b in fixed for i in range(a, b)}
        self.text = text
        found = [(i, c) for i, ch in enumerate(text) if i not in frozen and (c := _class_of(ch))]
        self.at, self.classes = [i for i, _ in found], [c[0] for _, c in found]
        self.values = [c[1] for _, c in found]
        shape = list(text)
        for i, cls in zip(self.at, self.classes, strict=True):
            shape[i] = cls[0]
        self.shape = "".join(shape)

    def feistel(self, key: bytes, back: bool = False) -> None:
        """A keyed one-to-one map of all texts of the shape: an alternating Feistel network over the symbols' classes."""
        v = self.values
        for r in range(5, -1, -1) if back else range(6):
            other = v[1 - r % 2 :: 2]
            seed = f"{r}|{self.shape}|{other}"
            turn = range(r % 2, len(v), 2)
            stream = b""
            for n, i in enumerate(turn):
                if n * 4 >= len(stream):
                    stream += hashlib.blake2b(f"{n}|{seed}".encode(), key=key, digest_size=64).digest()
                step = int.from_bytes(stream[n * 4 : n * 4 + 4], "big")
                v[i] = (v[i] + (-step if back else step)) % len(self.classes[i])

    def step(self, by: int) -> None:
        """The next number, or the one before; after the greatest comes zero."""
        for i, cls in enumerate(self.classes):
            self.values[i] += by
            if 0 <= self.values[i] < len(cls):
                return
            self.values[i] %= len(cls)

    def result(self) -> str:
        out = list(self.text)
        for i, cls, v in zip(self.at, self.classes, self.values, strict=True):
            out[i] = cls[v]
        return "".join(out)


def permute(text: str, key: bytes, fixed: tuple[tuple[int, int], ...] = (), back: bool = False) -> str:
    """The next text of its shape in a keyed order of them all, or the one before: one to one, and never the text itself if there are two."""
    s = _Symbols(text, fixed)
    s.feistel(key)
    s.step(-1 if back else 1)
    s.feistel(key, back=True)
    return s.result()


def _walk(text: str, key: bytes, structure, back: bool) -> str:
    """Permute until the structure, fixed spans among others, is that of the text again: a permutation of the texts of one structure."""
    fixed, kind = structure(text)
    out = permute(text, key, fixed, back)
    while out != text and structure(out) != (fixed, kind):
        out = permute(out, key, fixed, back)
    return out


@lru_cache(64)
def _given_order(sex: str, key: bytes) -> list[str]:
    return sorted(FEMALE if sex == "f" else MALE, key=lambda n: hashlib.blake2b(n.encode(), key=key, digest_size=8).digest())


def _name_word(word: str, key: bytes, back: bool) -> str:
    if word in _PARTICLES:
        return word
    if word in _GIVEN:
        order = _given_order(_GIVEN[word], key)
        return order[(order.index(word) + (-1 if back else 1)) % len(order)]
    return _walk(word, key, lambda w: ((), w in _GIVEN or w in _PARTICLES), back)


def _email_structure(t: str) -> tuple:
    ends = [m.span() for m in re.finditer(_AT + "|" + _DOT, t, re.I)]
    tail = ends[-1][0] if ends else len(t)
    return (*ends, (tail, len(t))), bool(re.match("(?i)mailto:", t))


def _phone_structure(t: str) -> tuple:
    m = re.match(r"(?:\+|00)\d{1,3}?(?=[ .(-])|\+\d{2}|\(?0?", t)
    return ((0, m.end() if m else 0),), None


def _address_structure(t: str) -> tuple:
    return tuple(m.span() for m in _KEEP_WORDS.finditer(t)), tuple(m[0].lower() for m in _KEEP_WORDS.finditer(t))


def _plain_structure(t: str) -> tuple:
    return (), None


_STRUCTURES = {"email": _email_structure, "phone": _phone_structure, "address": _address_structure}


def canonical(mention: str) -> str:
    """The form in which two mentions of the same are equal: composed accents, plain spaces and dashes, nothing invisible."""
    return unicodedata.normalize("NFC", flatten(mention)[0])


def surrogate(mention: str, kind: str, key: bytes) -> str:
    """A replacement of the same kind, script and format; the same for the same mention, different for different ones."""
    return _exchanged(canonical(mention), kind, key, False)


def original(made: str, kind: str, key: bytes) -> str:
    """The mention, in canonical form, of which a surrogate was made with this key."""
    return _exchanged(made, kind, key, True)


def _exchanged(text: str, kind: str, key: bytes, back: bool) -> str:
    if kind == "name":
        out = " ".join(_name_word(w, key, back) for w in text.split(" "))
    else:
        out = _walk(text, key, _STRUCTURES.get(kind, _plain_structure), back)
    if out == text and not back:  # nothing to exchange
        return f"{PLACEHOLDER[kind][:-1]}_{hashlib.blake2b(text.encode(), key=key, digest_size=6).hexdigest()}]"
    return out


def replace(text: str | None, key: bytes | None = None) -> str | None:
    """The text with each mention as a typed placeholder, or as a surrogate if a key is given."""
    return _replaced(text, mentions(text), key)


def _replaced(text: str | None, found: list[tuple[int, int, str]], key: bytes | None) -> str | None:
    if not found:
        return text
    out, done = [], 0
    for a, b, kind in found:
        out += [text[done:a], PLACEHOLDER[kind] if key is None else surrogate(text[a:b], kind, key)]
        done = b
    return "".join(out) + text[done:]


def find_personal(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """(row_id, field, kind, n): how often each kind is mentioned in each field."""

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        ids = b.column(0).to_pylist()
        for c, field in enumerate(fields):
            for i, found in zip(ids, mentions_of(b.column(c + 1).to_pylist()), strict=True):
                kinds = [k for _, _, k in found]
                out += [(i, field, k, kinds.count(k)) for k in dict.fromkeys(kinds)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["row_id", "field", "kind", "n"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("row_id"), *fields), kernel, "row_id bigint, field string, kind string, n bigint")


def replace_personal(df: DataFrame, id_col: str, fields: tuple[str, ...]) -> DataFrame:
    """The id and the fields, with a typed placeholder for every mention."""
    return _replace_fields(df, id_col, fields, None)


def surrogate_personal(df: DataFrame, id_col: str, fields: tuple[str, ...], key: bytes) -> DataFrame:
    """The id and the fields, with a surrogate for every mention; the key is the owner's secret, of 1 to 64 bytes."""
    return _replace_fields(df, id_col, fields, key)


def _replace_fields(df: DataFrame, id_col: str, fields: tuple[str, ...], key: bytes | None) -> DataFrame:
    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = []
        for c in b.columns[1:]:
            texts = c.to_pylist()
            cols.append(pa.array([_replaced(t, found, key) for t, found in zip(texts, mentions_of(texts), strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays([b.column(0), *cols], ["row_id", *fields])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("row_id"), *fields), kernel, "row_id bigint, " + ", ".join(f"{f} string" for f in fields))


def collisions(df: DataFrame, fields: tuple[str, ...], key: bytes) -> DataFrame:
    """(kind, made, n): surrogates that several different mentions of the corpus would get; the check of distinctness, empty unless there is a fault.

    Digests of mentions and surrogates are grouped, with partial counts on the map side; no mention leaves its task in the clear.
    """

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out: set[tuple[str, str, str]] = set()
        for c in b.columns:
            texts = c.to_pylist()
            for t, found in zip(texts, mentions_of(texts), strict=True):
                for a, z, kind in found:
                    digest = lambda x: hashlib.blake2b(x.encode(), key=key, digest_size=16).hexdigest()
                    out.add((kind, digest(surrogate(t[a:z], kind, key)), digest(canonical(t[a:z]))))
        cols = list(zip(*out, strict=True)) or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "made", "mention"])

    pairs = map_arrow(df.select(*fields), kernel, "kind string, made string, mention string").distinct()
    return pairs.groupBy("kind", "made").agg(F.count("*").alias("n")).where("n > 1")
