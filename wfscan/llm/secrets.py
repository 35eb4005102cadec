"""Problem 5: credentials inside source code and configuration, found by line and masked in place.

Texts are cut into lines by Arrow's kernels, and one RE2 pass (linear in the text) keeps the lines that can hold a credential at all;
only those reach Python. There each value is judged by its own form, by the name it is given to, and by the way it is used. A value
that shows nothing is decoded - base64, hex, percent and backslash escapes, in any number of layers, since each layer is shorter than
the one around it - and what comes out is scanned again line by line with all the rules; a hit makes the whole encoded literal a
credential. Binary that comes out is walked by its grammar: DER (plain and encrypted PKCS#8, PKCS#1, SEC1, PKCS#12), OpenSSH, Java
key stores and OpenPGP secret keys count, public keys and certificates don't. Literals joined by '+' are judged as one.

Map-only: whole texts, nothing shuffled. Results: null and empty texts hold no credential; lines are numbered from 1 and cut at line
feeds only; several values on one line give one row; repeated rows give theirs again. Masking keeps quotes, names, schemes and hosts;
a private key without its end mark ends at the first line that isn't the body of a key.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter, defaultdict
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfscan.llm.common import map_arrow

MASK = "[REDACTED]"
# Published forms of service tokens.
TOKEN = (
    r"(?:sk|rk|pk)_(?:live|test)_[0-9A-Za-z]{16,}|gh[pousr]_[0-9A-Za-z]{20,}|github_pat_\w{22,}|glpat-[\w-]{18,}|xox[abeoprs]-[\w-]{10,}"
    r"|SG\.[\w-]{16,}\.[\w-]{16,}|(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[\w-]{35}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,}|npm_[0-9A-Za-z]{30,}|sk-(?:ant-|proj-)?[\w-]{20,}|hf_[0-9A-Za-z]{25,}|ya29\.[\w-]{20,}"
)
_TOKEN = re.compile(rf"(?<![\w-])(?:{TOKEN})(?![\w-])")
_VENDOR = re.compile(r"(?<![\w-])[a-z]{3,12}_(?=\w*[a-z])(?=\w*[A-Z]\w*[A-Z]\w*[A-Z])(?=\w*(?:\d|[A-Z]{2}))[0-9A-Za-z]{24,}(?![\w-])")
_URL = re.compile(r"(?<=[\w+.-])://([^\s:/@'\"`<>{}]*):([^\s@/'\"`<>{}]+)@(?=[\w\[])")
_PARAM = re.compile(r"(?i)[?&;](?:sig|signature|key|api[_-]?key|token|access[_-]?token|auth|secret|client[_-]?secret|password|pwd)=([\w%+/=.~-]{16,})")
_PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_BODY = re.compile(r"(?:\\[nr]|[A-Za-z0-9+/=\s])*")  # what follows the begin mark on its line
_KEY_LINE = re.compile(r"[A-Za-z0-9+/=]+(?:\\[nr])*")
_KEY_HEADER = re.compile(r"\W*(?:Proc-Type|DEK-Info|Version|Comment|Charset|Hash|MessageID)\s*:", re.I)
_AUTH = re.compile(r"(?i)\b(basic|bearer|token|digest)\s+([\w+/=.~-]{8,})")
_STRING = r"\"(?:[^\"\\]+|\\.)*+\"|'(?:[^'\\]+|\\.)*+'|`(?:[^`\\]+|\\.)*+`"
_JOINED = re.compile(rf"({_STRING})((?:\s*\+\s*(?:{_STRING}))*)")
_ONE = re.compile(_STRING)
# What stands before a literal, for the line reversed: matched from the literal on, never searched for.
_NAME_BEFORE = re.compile(r"[brfu]?(?:\s*(?:\|\||\?\?|\bro\b)\s*[\w.$\[\]()]+)?\s*(?:>=|=:|[:=])\s*[\"'\]]*([\w$.-]+)")
_FALLBACK = re.compile(r"[brfu]?\s*(?:\|\||\?\?|\bro\b)")
_OPEN_NAME = re.compile(r"\s*+(?:\(\s*+)?(?:>=|=:|[:=])\s*[\"'\]]*([\w$.-]+)")
_QUOTE = re.compile(r"[\"'`]")
_QUOTED = re.compile(r"(?<!\\)(\\*+)([\"'`])")
_PLUS = re.compile(r"\s*\+\s*")
_BARE = re.compile(r"^\s*(?:(?://+|#+|/?\*+|--|;+|<!--)\s*|export\s+|-\s+)?[\"']?([\w$.-]+)[\"']?\s*(?:=>|[:=])\s*([^\s\"'`;(){}\[\],]+?)\s*(?:\*/|-->)?\s*$")
_UNQUOTED = re.compile(r"[:=]>?\s*+([^\s\"'`;,<>(){}\[\]=:?&]{16,}+={0,2}+)")
_PLACEHOLDER = re.compile(
    r"(?i)^(?:[x*.•#_-]+|<[^>]*>|\[[^\]]*\]|\$\{?.*|%[\w()]+%?|=?\s*\{\{.*|#\{.*|@\w+@|.*(?:replace|change)[-_ ]?(?:me|it|this)(?![a-z]).*|(?>.*?(?:insert|enter|put|add)[-_ ])(?>.*?(?:here|secret|key|token|password)(?![a-z])).*"
    r"|(?:my|your|example|sample|dummy|fake|test)[-_ ]?(?:own[-_ ])?(?:api|secret|token|key|pass|auth|access|client|private|cred|user|bot|app|value|string).*|.*(?:placeholder|redacted).*|example|sample|dummy"
    r"|todo|tbd|none|null|nil|undefined|true|false|test|changeme|secret|password|token|string|text|hidden|masked|empty|vault:.*|ssm:.*|env[:.].*|secretref:.*|arn:.*|kms:.*|op://.*|file:.*|process\.env.*|os\.(?:environ|getenv).*|!?(?:ref|sub|env|vault)\b.*|-?\d+(?:\.\d+)*)$"
)
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HEX = re.compile(r"^(?:[0-9a-f]{2})+$|^(?:[0-9A-F]{2})+$")
_B64 = re.compile(r"^[A-Za-z0-9+/_-]{16,}={0,2}$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_NOT_SECRET_NAME = {"integrity", "checksum", "sha", "sha1", "sha256", "sha512", "md5", "etag", "commit", "hash", "digest", "fingerprint", "rev", "revision", "head", "uuid", "guid", "id", "nonce", "public", "image", "icon", "svg", "url", "uri", "href", "src", "path", "endpoint", "length", "ttl", "name", "type", "count", "index", "hint", "label", "placeholder", "description"}
_SECRET_WORDS = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode", "secret", "secrets", "token", "credential", "credentials", "apikey", "secretkey", "privatekey", "accesskey", "authkey", "authtoken", "dsn", "bearer"}
_KEY_BEFORE = {"api", "secret", "private", "access", "auth", "encryption", "signing", "master", "service", "account", "storage", "shared", "license", "webhook", "subscription", "app"}
_NOTED = {"login", "creds", "cred", "account", "access"}  # what a note calls a password
_PASS_WORDS = {"password", "passwd", "pwd", "pass", "pw", "passphrase", "passcode"}

# Lines without any of these can't hold a credential; RE2 syntax.
CANDIDATE = (
    r"(?i:(?:pass|pwd|pw|login|creds?|secret|token|key|credentials?|dsn|auth|authorization|bearer)[\w\-]*[\"'\]]*\s*(?:=|:)\s*\S)|://[^\s/@]*:[^\s@/]+@|(?i:[?&](?:sig|signature|key|api_?key|token|access_token|auth|secret|password)=)"
    r"|-----(?:BEGIN|END) [A-Z0-9 ]*PRIVATE|(?i:basic|bearer) [\w+/=.~\-]{8,}|sk_live_|sk_test_|gh[pousr]_|glpat-|xox[a-z]-|SG\.|AKIA|ASIA|AIza|eyJ|npm_|sk-|hf_|[\"'`][A-Za-z0-9+/=_.\-]{16,}[\"'`]|[:=]>?\s*[A-Za-z0-9+/_\-]{16,}|[\"'`]\s*\+\s*[\"'`]|(?:\|\||\?\?|\bor)\s*[\"'`][^\s\"'`]{16,}[\"'`]"
    r"|\b[a-z]{3,12}_[0-9A-Za-z]{24,}|(?:\\x[0-9a-fA-F]{2}){8}|(?:\\u[0-9a-fA-F]{4}){6}|(?:%[0-9a-fA-F]{2}[^%\s]*){3}"
)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def secret_name(name: str) -> str | None:
    """'pass' for password-like names, 'key' for other secret-like ones, null for the rest."""
    words = [w.lower() for w in _WORDS.findall(name.replace("$", ""))]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in _NOT_SECRET_NAME or "public" in words:
        return None
    if words[-1] in _PASS_WORDS:
        return "pass"
    if words[-1] in _SECRET_WORDS or words[-1] in ("key", "keys") and len(words) > 1 and words[-2] in _KEY_BEFORE:
        return "key"
    return None


# Object identifiers, as bytes, of password-based encryption (PKCS#5 and PKCS#12) and of PKCS#7 contents.
_PBE = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_PKCS7 = b"\x2a\x86\x48\x86\xf7\x0d\x01\x07"
_OPENSSH = b"openssh-key-v1\0"
_KEY_STORES = (b"\xfe\xed\xfe\xed\0\0\0", b"\xce\xce\xce\xce\0\0\0")


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at a position."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n, at = int.from_bytes(data[at : at + k], "big"), at + k
    return (tag, at, at + n) if at + n <= len(data) else None


def der_private(data: bytes) -> bool:
    """Whether the bytes are a DER container of a private key."""
    outer = _element(data, 0)
    if not outer or outer[0] != 0x30:
        return False
    first = _element(data, outer[1])
    second = first and _element(data, first[2])
    if not second:
        return False
    if first[0] == 0x30:  # encrypted: a method of encryption by password, then the encrypted key
        oid = _element(data, first[1])
        return bool(oid and oid[0] == 0x06 and data[oid[1] : oid[2]].startswith(_PBE) and second[0] == 0x04 and second[2] <= outer[2])
    if first[0] != 0x02 or first[2] - first[1] != 1 or data[first[1]] > 3:
        return False
    if second[0] == 0x30:  # an algorithm and then the key, or a PKCS#12 store
        third, oid = _element(data, second[2]), _element(data, second[1])
        return bool(third and third[0] == 0x04 or data[first[1]] == 3 and oid and oid[0] == 0x06 and data[oid[1] : oid[2]].startswith(_PKCS7))
    return second[0] == 0x04 or second[0] == 0x02 and second[2] - second[1] >= 32


def pgp_secret(data: bytes) -> bool:
    """Whether the bytes begin with an OpenPGP packet of a secret key, of version 3 to 6 and within the data."""
    new = data[0] & 0x40
    if data[0] & 0x80 == 0 or (data[0] & 0x3F if new else data[0] >> 2 & 0x0F) != 5:
        return False
    if new:
        k, at = (0, 1) if data[1] < 192 else (1, 1) if data[1] < 224 else (4, 2)
        n, at = (data[1] if k == 0 else (data[1] - 192 << 8) + data[2] + 192 if k == 1 else int.from_bytes(data[2:6], "big")), at + k + (k < 4)
    else:
        k = 1 << (data[0] & 3)
        n, at = (int.from_bytes(data[1 : 1 + k], "big"), 1 + k) if k < 8 else (len(data) - 1, 1)
    return 3 <= data[at] <= 6 and 40 <= n <= len(data) - at


def key_container(data: bytes) -> bool:
    """Whether bytes are a container of private keys in any of the binary formats known here."""
    return len(data) >= 40 and (der_private(data) or data.startswith(_OPENSSH) or data.startswith(_KEY_STORES) or pgp_secret(data))


_ESCAPED = re.compile(r"\\x([0-9a-fA-F]{2})|\\u([0-9a-fA-F]{4})|\\([0-7]{3})")
_ESCAPED_BACKSLASH = re.compile(r"\\(?:x5[cC]|u005[cC])+(?=x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|[0-7]{3})")  # layers of escapes in one step
_ESCAPED_PERCENT = re.compile(r"%(?:25)+(?=[0-9a-fA-F]{2})")
_BREAKS = re.compile(r"(?:\\[nr]|\s)+")


def decodings(value: str):
    """The texts and bytes that one layer of encoding may hide; each is shorter than the value."""
    if "\\" in value and _ESCAPED.search(value):
        yield _ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16) if m[1] or m[2] else int(m[3], 8)), _ESCAPED_BACKSLASH.sub(r"\\", value)).encode("utf-8", "replace")
    if value.count("%") >= 3:
        yield unquote(_ESCAPED_PERCENT.sub("%", value)).encode("utf-8", "replace")
    lines = _BREAKS.split(value.strip())
    if len(lines) > 1 and min(map(len, lines[:-1])) >= 16:  # an encoded block broken into lines
        value = "".join(lines)
    if len(value) >= 24 and _HEX.match(value):
        yield bytes.fromhex(value)
    if len(value) >= 16 and _B64.match(value):
        try:
            yield base64.b64decode(value.replace("-", "+").replace("_", "/") + "=" * (-len(value) % 4), validate=True)
        except (ValueError, binascii.Error):
            pass


def hides_secret(value: str) -> bool:
    """Whether a credential appears once the layers of encoding are taken off.

    What a layer holds is scanned with all the rules, and its own encoded values go onto the stack instead of being judged in place.
    """
    todo, seen = [value], {value}
    while todo:
        for data in decodings(todo.pop()):
            if key_container(data):
                return True
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if not text.isprintable() and not text.replace("\n", "").replace("\r", "").replace("\t", "").isprintable():
                continue
            if _TOKEN.search(text) or _VENDOR.search(text) or _PRIVATE.search(text) or any(good_value(m[2], "pass") for m in _URL.finditer(text)):
                return True
            if (m := _BARE.match(text)) and (kind := secret_name(m[1])) and good_value(m[2], kind):
                return True
            lines, deeper = ["", *text.split("\n"), ""], [text.strip()]
            if any(scan_line(line, lines[k], lines[k + 2], deeper) for k, line in enumerate(lines[1:-1])):
                return True
            for inner in deeper:
                if len(inner) < len(value) and inner not in seen:
                    seen.add(inner)
                    todo.append(inner)
    return False


def good_value(v: str, kind: str) -> bool:
    """A literal that stands where a secret belongs: neither a placeholder nor a reference, and not an ordinary word."""
    if len(v) < 6 or any(c.isspace() for c in v) or _PLACEHOLDER.match(v) or _UUID.match(v) or "://" in v or v.startswith(("data:", "sha256-", "sha384-", "sha512-", "ssh-")):
        return False
    digits = sum(c.isdigit() for c in v)
    letters = sum(c.isalpha() for c in v)
    if kind == "pass":
        if letters == len(v) and v.islower():
            return len(v) >= 8
        return digits > 0 or not v.isalnum() and "." not in v and len(v) >= 8 and not re.fullmatch(r"[\w-]+", v)
    return len(v) >= 8 and digits > 0 and letters > 0 and (len(v) >= 16 or digits >= 2) and not re.fullmatch(r"v?\d+\.\d[\w.-]*|[A-Za-z]+\d{1,2}", v)


def random_value(v: str) -> bool:
    """A string too random to be a name, a word or a path."""
    if len(v) < 20 or not re.fullmatch(r"[A-Za-z0-9+/_=.-]+", v) or _UUID.match(v) or _PLACEHOLDER.match(v):
        return False
    if _HEX.match(v):
        return len(v) >= 32 and entropy(v) > 3
    digits, upper, lower = sum(c.isdigit() for c in v), sum(c.isupper() for c in v), sum(c.islower() for c in v)
    return digits >= 2 and upper + lower >= 8 and (upper >= 2 and lower >= 2 or digits >= 6) and entropy(v) > 3.5


def joined_literals(line: str):
    """_JOINED's matches. A quote sign opens a literal only if one of its kind that isn't escaped follows, so none is sought in vain."""
    last = {m[2]: m.end() - 1 for m in _QUOTED.finditer(line) if len(m[1]) % 2 == 0}
    at = 0
    while m := _QUOTE.search(line, at):
        at = m.end()
        if m.start() < last.get(m[0], 0) and (m := _JOINED.match(line, m.start())):
            at = m.end()
            yield m


def scan_line(line: str, before: str = "", after: str = "", deeper: list[str] | None = None) -> list[tuple[int, int]]:
    """Start and end of each credential value that begins on the line; encoded values are judged, or added to `deeper` if it is given."""

    def hidden(value: str) -> bool:
        if deeper is None:
            return hides_secret(value)
        deeper.append(value)
        return False

    spans: list[tuple[int, int]] = []
    ends: re.Match | bool | None = True
    for m in _PRIVATE.finditer(line):
        ends = ends and _PRIVATE_END.search(line, m.end())  # sought in vain once only
        spans.append((m.start(), ends.end() if ends else _KEY_BODY.match(line, m.end()).end()))
    for m in _TOKEN.finditer(line):
        if not _PLACEHOLDER.match(m[0]) and (re.search(r"\d", m[0]) or m[0][:4] in ("AKIA", "ASIA") and entropy(m[0]) > 2.5):
            spans.append(m.span())
    for m in _VENDOR.finditer(line):
        spans.append(m.span())
    for m in _URL.finditer(line):
        if not re.match(r"(?i)^(?:[x*.]+|<.*|\[.*|\$.*|%.*|your.*|pass(?:word)?|pwd|secret|changeme|user)$", m[2]) and "${" not in m[2] and not m[2].isdigit():
            spans.append(m.span(2))
    for m in _PARAM.finditer(line):
        if random_value(m[1]) or good_value(m[1], "key") and not _HEX.match(m[1]) and len(m[1]) >= 24:
            spans.append(m.span(1))
    for m in _AUTH.finditer(line):
        scheme, value = m[1].lower(), m[2]
        if scheme == "basic":
            try:
                user, sep, word = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
            except ValueError:
                continue
            if sep and word and user.isprintable() and not _PLACEHOLDER.match(word):
                spans.append(m.span(2))
        elif not _PLACEHOLDER.match(value) and good_value(value, "key") and len(value) >= 16 and (scheme != "token" or random_value(value)):
            spans.append(m.span(2))
    turned, indent = line[::-1], len(line) - len(line.lstrip())
    for m in joined_literals(line):
        parts = [m[1], *_ONE.findall(m[2])]
        end = m.end()
        if after and _PLUS.fullmatch(line, m.end()) and (more := _ONE.match(after.strip())):
            parts.append(more[0])
        value = "".join(p[1:-1] for p in parts)
        if len(value) < 6:
            continue
        left = len(line) - m.start()
        named = _NAME_BEFORE.match(turned, left)
        if not named and m.start() <= indent and before:
            named = _OPEN_NAME.match(before[::-1])
        name = named[1][::-1] if named else ""
        kind = secret_name(name)
        if kind and good_value(value, kind):
            spans.append((m.start() + 1, end - 1))
        elif len(parts) > 1 and (_TOKEN.search(value) or _VENDOR.search(value) or random_value(value)):
            spans.append((m.start() + 1, end - 1))
        elif _FALLBACK.match(turned, left) and random_value(value):
            spans.append((m.start() + 1, end - 1))
        elif len(value) >= 16 and not value.startswith("data:") and "integrity" not in name.lower() and hidden(value):
            spans.append((m.start() + 1, end - 1))
    comment = line.lstrip()[:1] in ("/", "#", "*", "-", ";", "<")
    if (m := _BARE.match(line)) and (kind := secret_name(m[1]) or ("pass" if comment and m[1].lower() in _NOTED else None)):
        value = m[2]
        if good_value(value, kind) and (kind == "pass" and comment or random_value(value) or re.search(r"\d", value) and not re.search(r"\.[a-z]|->|::", value) and (kind == "pass" or entropy(value) > 3)):
            spans.append(m.span(2))
        elif len(value) >= 16 and hidden(value):
            spans.append(m.span(2))
    spans += [m.span(1) for m in _UNQUOTED.finditer(line) if hidden(m[1])]
    return _merged(spans)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def candidate_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row of each line, position of the lines that may hold a credential, lines) of a batch of texts."""
    texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts, "")
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    rows = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    hits = pc.match_substring_regex(lines, CANDIDATE).to_numpy(zero_copy_only=False)
    return rows, np.flatnonzero(hits), lines


def find_in_batch(texts: pa.Array) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(row, line number, spans) of each line with a credential."""
    rows, at, lines = candidate_lines(texts)
    if not len(at):
        return []
    starts = np.searchsorted(rows, np.arange(len(texts)))
    last = len(rows) - 1
    these = lines.take(pa.array(at)).to_pylist()
    before = lines.take(pa.array(np.maximum(at - 1, 0))).to_pylist()
    after = lines.take(pa.array(np.minimum(at + 1, last))).to_pylist()
    out = []
    for k, line, prev, nxt in zip(at.tolist(), these, before, after, strict=True):
        row = int(rows[k])
        first = k == starts[row]
        spans = scan_line(line, "" if first else prev, nxt if k < last and rows[k + 1] == row else "")
        if spans:
            out.append((row, k - int(starts[row]) + 1, spans))
    return out


def find_secrets(df: DataFrame, id_col: str, text_cols: dict[str, str]) -> DataFrame:
    """(origin, row_id, line_no): the lines of each text column, under the origin it is given, on which a credential begins."""
    names = list(text_cols)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        origins, ids, lines = [], [], []
        row_ids = b.column(0).to_pylist()
        for c, name in enumerate(names):
            for row, line, _ in find_in_batch(b.column(c + 1)):
                origins.append(text_cols[name])
                ids.append(row_ids[row])
                lines.append(line)
        return pa.RecordBatch.from_arrays([pa.array(origins, pa.string()), pa.array(ids, pa.int64()), pa.array(lines, pa.int64())], ["origin", "row_id", "line_no"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("row_id"), *names), kernel, "origin string, row_id bigint, line_no bigint")


def _key_line(line: str, full: bool, ended: bool) -> tuple[int, int] | None:
    """Where the body of a private key stands on a line, between quotes, signs and margins; null if the line is something else.

    full: whether the line before was a full line of the body, after which a shorter one may come; ended: whether an end mark follows.
    """
    core = line.strip(" \t\r\"'`+,;#*|>\\")
    if not core or _KEY_HEADER.match(line):
        return 0, 0
    a = line.index(core)
    if not _KEY_LINE.fullmatch(core):
        return None
    short = full and (core[-1] == "=" or any(c.isdigit() for c in core) or core.lower() != core != core.upper())
    return (a, a + len(core)) if ended or len(core) >= 40 or short else None


def mask_text(text: str | None) -> str | None:
    return masked(text, {line: spans for _, line, spans in find_in_batch(pa.array([text]))}) if text else text


def masked(text: str, found: dict[int, list[tuple[int, int]]]) -> str:
    """The text with the spans of its lines masked; found: spans by line number."""
    lines, within, full = text.split("\n"), False, False
    ending, ahead = [False] * len(lines), False  # whether the next mark below a line is that of an end
    if "PRIVATE KEY" in text:
        for i in range(len(lines) - 1, -1, -1):
            ending[i] = ahead
            ahead = bool(_PRIVATE_END.search(lines[i])) or ahead and not _PRIVATE.search(lines[i])
    for i, line in enumerate(lines):
        if within:
            if ends := _PRIVATE_END.search(line):
                lines[i] = re.sub(r"[A-Za-z0-9+/=]{4,}", MASK, line[: ends.start()]) + line[ends.start() :]
                within = False
                continue
            body = _key_line(line, full, ending[i])
            if body:
                a, b = body
                lines[i] = line[:a] + MASK + line[b:] if b > a else line
                full = b - a >= 40
                continue
            within = False
        if i + 1 in found:
            for a, b in reversed(found[i + 1]):
                if m := _PRIVATE.match(line[a:b]):
                    tail, rest = line[a + m.end() : b], line[b:]
                    ended = _PRIVATE_END.search(tail)
                    within = not ended and not rest.strip(" \t\r\"'`+,;\\")
                    full = True
                    line = line[: a + m.end()] + (MASK + tail[ended.start() :] if ended and ended.start() else tail if ended else MASK if tail.strip() else tail) + rest
                else:
                    line = line[:a] + MASK + line[b:]
            lines[i] = line
    return "\n".join(lines)


def mask_secrets(df: DataFrame, id_col: str, text_cols: dict[str, str]) -> DataFrame:
    """(origin, row_id, text): every text with a credential, with nothing but the values masked."""
    names = list(text_cols)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        row_ids = b.column(0).to_pylist()
        for c, name in enumerate(names):
            found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(dict)
            for row, line, spans in find_in_batch(b.column(c + 1)):
                found[row][line] = spans
            out += [(text_cols[name], row_ids[r], masked(b.column(c + 1)[r].as_py(), lines)) for r, lines in found.items()]
        cols = list(zip(*out, strict=True)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["origin", "row_id", "text"])

    return map_arrow(df.select(F.col(id_col).cast("bigint").alias("row_id"), *names), kernel, "origin string, row_id bigint, text string")
