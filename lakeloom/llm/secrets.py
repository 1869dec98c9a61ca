"""Credentials embedded in source code and configuration.

A text is scanned for tokens of known formats, private keys, logins in URLs and
headers, and literals that are assigned to secret names.  Literals that hold an
encoding (base64, hex, percent, escapes) are decoded, layer by layer, and
scanned again; binary results are parsed as key containers by their grammar.  A
hit inside an encoded literal stands for the whole literal.  Literals that are
added up from pieces are scanned as one.  Redaction replaces the secret values
only; everything around them stays byte for byte.
"""

from __future__ import annotations

import base64
import binascii
import re
import string
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "REDACTED"

#: Public token formats (fixed values).
FORMATS = (
    r"gh[pousr]_[A-Za-z0-9]{30,}", r"github_pat_[A-Za-z0-9_]{40,}", r"gl(?:pat|dt|rt|ptt|soat|cbt)-[A-Za-z0-9_\-]{18,}", r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    r"AIza[A-Za-z0-9_\-]{33,36}", r"ya29\.[A-Za-z0-9_\-]{20,}", r"xox[abposr]-[A-Za-z0-9\-]{16,}", r"xapp-[A-Za-z0-9\-]{20,}",
    r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}", r"whsec_[A-Za-z0-9+/=]{16,}", r"sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}", r"hf_[A-Za-z0-9]{30,}",
    r"npm_[A-Za-z0-9]{30,}", r"pypi-[A-Za-z0-9_\-]{40,}", r"do[opr]_v1_[a-f0-9]{60,}", r"hv[sbr]\.[A-Za-z0-9_\-]{20,}", r"SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{30,}",
    r"shp(?:at|ca|pa|ss)_[a-fA-F0-9]{32}", r"sq0(?:atp|csp)-[A-Za-z0-9_\-]{22,}", r"key-[a-f0-9]{32}", r"dckr_pat_[A-Za-z0-9_\-]{20,}", r"lin_api_[A-Za-z0-9]{32,}",
    r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{16,}",
)
FORMAT = re.compile(r"(?<![A-Za-z0-9_])(?:" + "|".join(FORMATS) + r")(?![A-Za-z0-9])")
#: What every token format begins with; a cheap first look.
FORMAT_HINT = re.compile(r"gh[pousr]_|github_pat|gl(?:pat|dt|rt|ptt|soat|cbt)-|AKIA|ASIA|AIza|ya29\.|xox[abposr]-|xapp-|[sr]k_|whsec_|sk-|hf_|npm_|pypi-|do[opr]_v1|hv[sbr]\.|SG\.|shp|sq0|key-|dckr_|lin_api|eyJ")

PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----(.{40,}?)-----END \1-----", re.S)
PEM_OPEN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----((?:\\[nr]|[\s\"'+,#*/\\]|[A-Za-z0-9+/=:\-])*)", re.S)

URL_LOGIN = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]*://([^\s/:@\"'`<>]*):([^\s/@\"'`<>]+)@[A-Za-z0-9\[]")
PATH_LOGIN = re.compile(r"(?:^|/)([A-Za-z0-9_.\-]+):([^/:@\s]{6,})@[A-Za-z0-9]")
HEADER = re.compile(r"\b(Bearer|Basic|Token|token|ApiKey|Digest)[ \t]+([A-Za-z0-9+/_.~\-]{12,}={0,2})")
_HEADER_HINT = re.compile(r"(?:Bearer|Basic|[Tt]oken|ApiKey|Digest)[ \t]")

#: Words that make a name a secret's name, in several languages (fixed values).
SECRET_WORD = re.compile(
    r"(?i)passwor[dt]|passwd|passphrase|pass_?code|kennwort|contrase[nñ]a|mot_?de_?passe|clave|senha|пароль|密码|パスワード|secret|credential|"
    r"api[_\-]?key|access[_\-]?key|auth[_\-]?key|private[_\-]?key|signing[_\-]?key|sign[_\-]?key|hmac[_\-]?key|encryption[_\-]?key|encrypt[_\-]?key|master[_\-]?key|service[_\-]?key|session[_\-]?key|account[_\-]?key|"
    r"token|(?<![a-zA-Z])pwd|(?<![a-zA-Z])pw(?![a-z])|(?<![a-zA-Z])pass(?![a-z])|(?<![a-zA-Z])auth(?![a-z])|(?<![a-zA-Z])jwt|bearer"
)
#: Endings that make a name speak about a secret instead of holding one (fixed values).
ABOUT = re.compile(
    r"(?i)(?:hash|hashed|digest|label|field|name|url|uri|endpoint|path|file|dir|policy|length|len|size|type|kind|expiry|expires?|ttl|count|limit|prefix|suffix|header|"
    r"regex|pattern|hint|title|text|prompt|placeholder|param|min|max|required|enabled|status|ref|arn|issuer|scope|scopes|algorithm|alg|age|days|version|provider|checksum|fingerprint|public|reset)s?$"
)
ABOUT_START = re.compile(r"(?i)^(?:max|min|num|n|count|total|public|is|has|use|no|show|hide|forgot|reset|change|hash|hashed|encrypted|masked|next)[_\-]?(?=[_\-A-Z]|tokens?|pass|secret|api)|tokens$|public")

#: What every secret word contains, in lower case; and what a remark about a login contains.
_STEMS = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "clave", "senha", "credential", "contrase", "jwt", "bearer", "kennwort", "пароль", "密码", "パスワード")
_REMARK_STEMS = ("login", "credential", "creds", "password", "passwort", " key", "user/pass", "zugang", "mot de passe", "contraseña")


def _places(lower: str, stems: tuple[str, ...]) -> list[int]:
    out = []
    for stem in stems:
        at = lower.find(stem)
        while at >= 0:
            out.append(at)
            at = lower.find(stem, at + len(stem))
    return out


_NAME = string.ascii_letters + string.digits + "_-."
_TAIL = re.compile(r"[\w.\-]*")
#: From a name to its value: closing quote, type note, sign of assignment.
#: Line ends are bounded, blanks are not; blanks are taken possessively, so a long run costs its length once.
_ASSIGN = re.compile(
    r"""["'`]?\s{0,3}[ \t]*+(?:\]|\))?\s{0,2}[ \t]*+(?::\s{0,2}[ \t]*+&?(?:'static\s)?[A-Za-z][\w<>\[\]?.]*\s{0,3}[ \t]*+(?=[:=]))?(?:=>|:=|===?|!==?|=|:|(?:"\s+|(?<=\s)\s*)value\s*=)\s{0,6}[ \t]*+"""
)
_QUOTED = re.compile(r"""[bBrRfFuU@$]{0,2}(?:\"\"\"|'''|"|'|`)""")
_BARE = re.compile(r"[^\s\"'`,;()\[\]{}<>]\S*")
_FLAG = re.compile(r"(?i)(?<![\w])--?([a-z][a-z\-]*?(?:password|passwd|pwd|pass|secret|token|api-?key|secret-key|access-key|key))(?:=|[ \t]+)([^\s\"',\]]{6,})")
_LOGIN_FLAG = re.compile(r"(?<![\w-])(?:-u|--user)[ =]+[\"']?([\w.@\-]+):([^\s\"']{6,})")
_PHRASE = re.compile(r"(?i)(?:#|//|--|;|\*|<!--|^)[^\n]{0,60}?\b(?:login|credentials?|creds|password|passwort|pw|old key|key|user/pass|zugang|mot de passe|contraseña)\b[^:\n]{0,60}:[ \t]+(?:[\w.@\-]+ ?/ ?)?([^\s/:\"'`]{8,})[ \t]*(?:-->|\*/)?[ \t\r]*$", re.M)
_PIECES = re.compile(r"""(["'`])((?:[^"'`\\\n]|\\.)*)\1(?:\s*(?:\+|\.|~|&|<>|\.\.|\|\|)?\s*\\?\s*(["'`])((?:[^"'`\\\n]|\\.)*)\3)+""")
_PIECE = re.compile(r"""(["'`])((?:[^"'`\\\n]|\\.)*)\1""")
_LITERAL = re.compile(r"""(["'`])([^"'`\n]{16,}?)\1|(?<=[=:\s])([A-Za-z0-9+/_\-%\\=]{24,})(?=\s|$)""", re.M)
#: An encoding over several lines: lines of one alphabet, the marks of a comment or a continued string around them.
_BLOCK = re.compile(r"""(?:^[ \t]*+(?:(?:#|//|\*|--|;)[ \t]*+)?["'`]?[A-Za-z0-9+/_\-]{24,}+={0,2}(?:\\n)?["'`]?[ \t]*+(?:\\|\+|,|\.)?[ \t]*+\r?\n)+[ \t]*+(?:(?:#|//|\*|--|;)[ \t]*+)?["'`]?[A-Za-z0-9+/_\-]{4,}+={0,2}""", re.M)
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{4,}={0,2}")
#: The first line of an encoding may follow an opening quote or a sign on the line of its name.
_BLOCK_HEAD = re.compile(r"""["'`=:|]{1,3}[ \t]*([A-Za-z0-9+/_\-]{24,}={0,2})(?:\\n)?["'`]?[ \t]*(?:\\|\+|,|\.)?[ \t]*\r?\n$""")

CONFIG_EXT = re.compile(r"(?i)(?:\.(?:env|ini|ya?ml|toml|cfg|conf|config|properties|npmrc|pypirc|netrc|sample|example|tfvars|tf|hcl|sh|bash|zsh|dockerfile|json|txt|md|rst|xml|plist|service|pgpass|htpasswd)|dockerfile|\.env[.\w]*)$")

UUID = re.compile(r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$")
DIGEST = re.compile(r"(?i)^(?:\$(?:2[abxy]?|5|6|1|argon2\w*|scrypt|pbkdf2[\w\-]*|apr1)\$|\{?(?:s?sha\d*|md5|crypt|bcrypt|pbkdf2)[:}\-$]|sha(?:1|224|256|384|512)[:\-]|md5:)")
ENCRYPTED = re.compile(r"(?i)^(?:ENC[\[(]|!vault|\$ANSIBLE_VAULT|AQI[A-Z]|vault:v\d|sops|age1|-----BEGIN AGE|\{cipher\}|kms:|enc:|encrypted:|ciphertext)")
REFERENCE = re.compile(
    r"(?i)^(?:\$\{?\w|\$\(|\{\{|<%|%\(|%\w+%$|\{\w*\}$|<[^>]*>$|@\w+\(|vault[:./]|secret[s]?[:./]|ssm[:./]|env[:.(\[]|process\.env|os\.(?:environ|getenv)|getenv|System\.getenv|std::env|config[.\[(]|settings[.\[(]|self\.|this\.|var\.|local\.|data\.|module\.|arn:|op://|keyring|file:|gcp|azurekeyvault|!\w+ )|\$\{[^}]*\}|\{\{[^}]*\}\}|%\([^)]*\)s|#\{[^}]*\}"
)
#: Parts of values that only stand for a secret (fixed values).
SAMPLE = re.compile(
    r"(?i)replace|change.?me|changeit|example|dummy|sample|your[_\-. ]|placeholder|not.?a.?real|not.?real|fake|todo|fixme|redacted|masked|insert|to.?be.?(?:set|filled)|<.*>|\*{3,}|x{4,}|\.{3,}|•{3,}|#{4,}|"
    r"^(?:none|null|nil|undefined|true|false|yes|no|empty|unset|default|password|passwort|secret|token|changeme|test|foo|bar|n/?a|tbd|string|str|int|any|bytes)$|^my[_\-]|_here$|-here$|^(?:0+|1234567890|0123456789\w*|abc(?:def)?\w*123\w*|deadbeef\w*)$"
)

#: The farthest that a remark begins before the last colon of its line: sign, gap, word, gap.
_REMARK_REACH = 160
#: Length from which a short sample word may stand in a random value by chance.
_LONG = 1000


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    kind: str
    at: int  # the position whose line is reported


def secret_name(name: str) -> bool:
    """Is this the name of something that holds a secret?"""
    name = name.strip(".-_")
    if not SECRET_WORD.search(name) or ABOUT_START.search(name):
        return False
    return not ABOUT.search(name)


def _sample(v: str) -> bool:
    """Does the value only stand for a secret?  In a long one, a sample word counts only if it stands alone."""
    if len(v) <= _LONG:
        return bool(SAMPLE.search(v))
    return any(not v[max(m.start() - 1, 0) : m.start()].isalnum() and not v[m.end() : m.end() + 1].isalnum() for m in SAMPLE.finditer(v))


#: Words of sentences, which no pass phrase is made of (fixed values).
_SENTENCE = re.compile(r"(?i)\b(?:the|a|an|your|you|my|our|please|enter|type|must|should|is|are|was|be|not|for|of|to|in|on|at|with|and|or|if|forgot|reset|new|old|wrong|invalid|incorrect|confirm|repeat|again|password|passphrase|phrase|secret|der|die|das|bitte|ihr|ist|le|la|votre|de|du|el|su|oublié|nueva)\b")
PHRASE_NAME = re.compile(r"(?i)pass_?-?phrase|mnemonic|seed_?-?(?:phrase|words)|recovery_?-?phrase|passwor[dt]$|passwd$|kennwort$")


def phrase(name: str, v: str) -> bool:
    """Is this a pass phrase, several words that make no sentence, under the name of one?"""
    words = v.split()
    return bool(PHRASE_NAME.search(name)) and 4 <= len(words) <= 48 and all(re.fullmatch(r"[a-z]{3,10}\d{0,3}", w) for w in words) and len(set(words)) > 2 and not _SENTENCE.search(v)


def usable(v: str) -> bool:
    """Can this literal be used as a secret as it stands?"""
    v = v.strip()
    if len(v) < 6 or any(c.isspace() for c in v):
        return False
    if UUID.match(v) or DIGEST.match(v) or ENCRYPTED.match(v) or REFERENCE.search(v) or _sample(v):
        return False
    if re.match(r"(?i)^(?:https?|wss?|ftp|file)://", v) or re.match(r"^[./~]*/?(?:[\w.\-]+/)+[\w.\-]*\.\w{1,5}$", v) or v.startswith(("./", "~/", "#", "input[")) or re.match(r"^/[a-z0-9_.\-/]*$", v):
        return False
    if re.search(r"\.(?:pem|crt|key|json|ya?ml|txt|invalid|com|org|net|io)(?::\d+)?$", v) or "ssh-" in v[:5]:
        return False
    if re.match(r"^[a-z_]+(?:[./\-][a-z_]+)+$", v) or re.match(r"^[\d.,:]+$", v):
        return False
    kinds = [any(c.islower() for c in v), any(c.isupper() for c in v), any(c.isdigit() for c in v), any(not c.isalnum() for c in v)]
    if sum(kinds) < 2:
        return False
    if not kinds[2]:  # without a digit only a mix of cases and signs is no name
        turns = len(re.findall(r"(?=[a-z][A-Z]|[A-Z][a-z])", v))
        return sum(kinds) >= 3 and bool(re.search(r"[^\w.\-/]", v)) or turns >= 4
    return True


# --- layers -----------------------------------------------------------------

_B64 = re.compile(r"^[A-Za-z0-9+/]{16,}={0,2}$")
_B64U = re.compile(r"^[A-Za-z0-9_\-]{16,}={0,2}$")
_HEX = re.compile(r"^(?:0x)?(?:[0-9a-fA-F]{2}){12,}$")
_ESC = re.compile(r"\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}")
_PCT = re.compile(r"%[0-9a-fA-F]{2}")


def layers(v: str) -> Iterator[bytes]:
    """What the literal is an encoding of, by every encoding that it fits."""
    bare = re.sub(r"\s|\\n|\\r", "", v)
    if _ESC.search(v):
        try:
            yield v.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("latin-1", "replace")
        except (UnicodeDecodeError, UnicodeEncodeError):
            pass
    if _PCT.search(v):
        yield urllib.parse.unquote_to_bytes(v)
    if _HEX.match(bare):
        yield bytes.fromhex(bare.removeprefix("0x"))
    if _B64.match(bare) or _B64U.match(bare):
        try:
            yield base64.urlsafe_b64decode(bare.rstrip("=").replace("+", "-").replace("/", "_") + "=" * (-len(bare.rstrip("=")) % 4))
        except (binascii.Error, ValueError):
            pass


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the DER element at a position, if it is one."""
    if at + 2 > len(data):
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size & 0x80:
        k = size & 0x7F
        if not 1 <= k <= 4 or start + k > len(data):
            return None
        size, start = int.from_bytes(data[start : start + k], "big"), start + k
    return (tag, start, start + size) if start + size <= len(data) else None


class _Fields:
    """Big-endian fields of a binary container, read one after the other; a field beyond the end raises ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("beyond the end")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def counted(self, n: int) -> bytes:
        """A field whose length stands before it in n bytes."""
        return self.take(self.number(n))


def _openssh(f: _Fields) -> str | None:
    """Magic, cipher, key derivation and its options, count, public keys, then the private section."""
    f.take(15)
    cipher, kdf, _ = f.counted(4), f.counted(4), f.counted(4)
    keys = f.number(4)
    for _ in range(keys):
        f.counted(4)
    return "openssh" if keys and cipher == kdf == b"none" and len(f.counted(4)) >= 8 else None


def _jks(f: _Fields) -> str | None:
    """Magic, version, count, then entries of tag, alias and date.

    A store whose entries are all certificates (tag 2) is none; one that ends
    or breaks before that is shown is held for one with a key.
    """
    f.take(4)
    version, count = f.number(4), f.number(4)
    for _ in range(count):
        tag = f.number(4)
        f.counted(2), f.take(8)
        if tag != 2:
            return "jks"
        if version == 2:
            f.counted(2)
        f.counted(4)
    return None


def _putty(text: str) -> str | None:
    """Header lines of name and value; the private part has as many lines of base64 as its header says."""
    lines = text.replace("\r", "").split("\n")
    head = {k.strip(): v.strip() for k, c, v in (x.partition(":") for x in lines) if c}
    if head.get("Encryption") != "none" or not head.get("Private-Lines", "").isdigit():
        return None
    at = next(i for i, x in enumerate(lines) if x.startswith("Private-Lines:"))
    body = lines[at + 1 : at + 1 + int(head["Private-Lines"])]
    return "putty" if body and all(re.fullmatch(r"[A-Za-z0-9+/=]+", x) for x in body) else None


#: Object ids of the contents of a PKCS#12 file, in DER (fixed values).
_DATA_OID, _ENCRYPTED_OID = bytes.fromhex("2a864886f70d010701"), bytes.fromhex("2a864886f70d010706")
_KEY_BAGS = (bytes.fromhex("2a864886f70d010c0a0101"), bytes.fromhex("2a864886f70d010c0a0102"))


def _children(data: bytes, lo: int, hi: int) -> list[tuple[int, int, int]]:
    out = []
    while lo < hi and (e := _der(data, lo)) and e[2] <= hi:
        out.append(e)
        lo = e[2]
    return out


def _oids(data: bytes, lo: int, hi: int) -> Iterator[bytes]:
    """The object ids of a DER range, those inside octet strings of DER included."""
    left = [(lo, hi)]
    while left:
        lo, hi = left.pop()
        for tag, a, b in _children(data, lo, hi):
            if tag == 0x06:
                yield data[a:b]
            elif tag & 0x20 or tag == 0x04:
                left.append((a, b))


def _pkcs12(data: bytes, auth: tuple[int, int, int]) -> str | None:
    """The safe's content type, then its bags: a key bag in the open, or an encrypted safe that may hold one.

    Only a safe whose bags are readable and hold no key is none.
    """
    parts = _children(data, auth[1], auth[2])
    if len(parts) < 2 or data[parts[0][1] : parts[0][2]] != _DATA_OID:
        return "pkcs12"
    found = set(_oids(data, parts[1][1], parts[1][2]))
    return "pkcs12" if found & {*_KEY_BAGS, _ENCRYPTED_OID} else None


def key_container(data: bytes) -> str | None:
    """The kind of private key container that the bytes are, None for anything else.

    OpenSSH, JKS and PuTTY files by their fields; PKCS#1, PKCS#8, SEC 1 and
    PKCS#12 by their DER elements.  Encrypted keys, public keys, certificates,
    and stores that hold only certificates are none.
    """
    try:
        if data.startswith(b"openssh-key-v1\0"):
            return _openssh(_Fields(data))
        if data.startswith(b"PuTTY-User-Key-File-"):
            return _putty(data.decode("latin-1"))
    except ValueError:
        return None
    if data[:4] == b"\xfe\xed\xfe\xed":
        try:
            return _jks(_Fields(data))
        except ValueError:
            return "jks"
    top = _der(data)
    if not top or top[0] != 0x30 or len(data) - top[2] > 2:
        return None
    first = _der(data, top[1])
    if not first or first[0] != 0x02 or first[2] - first[1] > 1 or first[2] == first[1]:
        return None
    version = data[first[1]]
    second = _der(data, first[2])
    if not second or second[2] > top[2]:
        return None
    if version == 3 and second[0] == 0x30:
        return _pkcs12(data, second)
    if version == 1 and second[0] == 0x04 and second[2] - second[1] >= 16:
        return "sec1"
    if version in (0, 1) and second[0] == 0x30:
        oid, third = _der(data, second[1]), _der(data, second[2])
        return "pkcs8" if oid and oid[0] == 0x06 and third and third[0] == 0x04 else None
    if version in (0, 1) and second[0] == 0x02:
        n, at = 1, second[2]
        while at < top[2] and (e := _der(data, at)) and e[0] == 0x02:
            n, at = n + 1, e[2]
        return "pkcs1" if n >= 5 and at == top[2] else None
    return None


#: Runs by which a sign is encoded over and over; each layer only takes one unit off.
_CHAIN = re.compile(r"(?i)(?<=%)(25)(?:25){8,}|(?<=\\)(x5c|u005c|134)(?:\2){8,}")


def _inside(v: str) -> str | None:
    """The kind of secret that a literal encodes in any number of layers, if it does.

    What a layer decodes to is shorter than the literal, so the layers end.
    """
    left, tried = [v], set()
    while left:
        v = _CHAIN.sub(lambda m: (m.group(1) or m.group(2)) * 8, left.pop())
        if v in tried:
            continue
        tried.add(v)
        more = []
        for data in layers(v):
            if not data:
                continue
            if kind := key_container(data):
                return kind
            try:
                text = data.decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(text) < 8 or text == v or sum(c.isprintable() or c in "\r\n\t" for c in text) < len(text):
                continue
            for h in _open_hits(text, True):
                return h.kind
            # The decoded text may itself be one encoded literal, without anything around it.
            if not re.search(r"\s", bare := text.strip()):
                more.append(bare)
            more += [text[lo:hi] for lo, hi in _literals(text)]
        left += reversed(more)
    return None


# --- scan -------------------------------------------------------------------


def _name_before(text: str, start: int, end: int) -> tuple[int, str]:
    while start > 0 and text[start - 1] in _NAME:
        start -= 1
    return start, text[start : _TAIL.match(text, end).end()]


def _literal_at(text: str, at: int, bare: bool) -> list[tuple[int, int]] | None:
    """Spans of the literal at a position, one for each of its pieces."""
    q = _QUOTED.match(text, at)
    if q:
        quote = q.group().lstrip("bBrRfFuU@$")
        spans, lo = [], q.end()
        while True:
            hi = lo
            eol = text.find("\n", lo) if len(quote) == 1 and quote != "`" else -1
            stop = eol if eol >= 0 else len(text)
            while True:
                hi = text.find(quote, hi, stop)
                if hi < 0:
                    return spans or None
                back = 0
                while hi - 1 - back >= lo and text[hi - 1 - back] == "\\":
                    back += 1
                if back % 2 == 0 or quote == "`":
                    break
                hi += 1
            spans.append((lo, hi))
            more = re.compile(r"\s*(?:\+|\.\.|\.|~|&|\\)?\s*[bBrRfFuU]?(" + re.escape(quote) + r")").match(text, hi + len(quote))
            if not more or len(quote) > 1 or (not text[hi + 1 : more.end() - 1].strip() and quote == "`"):
                return spans
            if not re.search(r"[+.~&\\]", text[hi + 1 : more.end() - 1]) and "\n" not in text[hi + 1 : more.end()]:
                return spans
            lo = more.end()
    if bare and (b := _BARE.match(text, at)):
        eol = text.find("\n", at)
        rest = text[at : eol if eol >= 0 else len(text)].rstrip()
        value = re.split(r"\s+[#;]|\s*//\s", rest)[0].rstrip().rstrip(",;")
        return [(at, at + len(value))] if value and not re.search(r"\s", value) else None
    return None


def _literals(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the literals that may be an encoding."""
    for m in _LITERAL.finditer(text):
        yield m.span(2 if m.group(2) else 3)


def _blocks(text: str) -> Iterator[list[tuple[int, int]]]:
    """Spans of the lines of each encoding that stands on several lines, and of pieces that are added up."""
    for m in _BLOCK.finditer(text):
        spans = []
        for line in re.finditer(r"[^\n]+", m.group()):
            if run := max(_RUN.finditer(line.group()), key=lambda r: len(r.group()), default=None):
                spans.append((m.start() + line.start() + run.start(), m.start() + line.start() + run.end()))
        head = _BLOCK_HEAD.search(text, text.rfind("\n", 0, max(m.start() - 1, 0)) + 1, m.start())
        if head:
            spans.insert(0, head.span(1))
        # The last line may belong to what follows.
        yield spans
        if len(spans) > 2:
            yield spans[:-1]
    for m in _PIECES.finditer(text):
        parts = [p.span(2) for p in _PIECE.finditer(text, m.start(), m.end())]
        if len(parts) > 1 and sum(hi - lo for lo, hi in parts) >= 16:
            yield parts


def _open_hits(text: str, config: bool) -> list[Hit]:
    """The secrets of a text that stand in it as they are."""
    hits: list[Hit] = []

    def add(start: int, end: int, kind: str, at: int | None = None) -> None:
        if end > start:
            hits.append(Hit(start, end, kind, start if at is None else at))

    if "PRIVATE KEY" in text:
        for m in PEM_OPEN.finditer(text):
            if "ENCRYPTED" in m.group(1) or "Proc-Type" in m.group(2)[:60]:
                continue
            body = m.group(2)
            stop = re.search(r"-{4,}", body)
            body = body[: stop.start()] if stop else body
            if len(re.findall(r"[A-Za-z0-9+/=]", body)) >= 40:
                add(m.start(2), m.start(2) + len(body), "private_key", m.start())
    if FORMAT_HINT.search(text):
        for m in FORMAT.finditer(text):
            if not SAMPLE.search(m.group()):
                add(m.start(), m.end(), "token")
        for m in _PIECES.finditer(text):
            parts = list(_PIECE.finditer(text, m.start(), m.end()))
            if len(parts) > 1 and FORMAT_HINT.match(parts[0].group(2)) and FORMAT.fullmatch("".join(p.group(2) for p in parts)):
                for p in parts:
                    add(p.start(2), p.end(2), "token", parts[0].start(2))
    if "://" in text and "@" in text:
        for m in URL_LOGIN.finditer(text):
            v = urllib.parse.unquote(m.group(2))
            if len(v) >= 4 and not REFERENCE.search(m.group(2)) and not SAMPLE.search(v) and not ENCRYPTED.match(v):
                add(m.start(2), m.end(2), "url_login")
    for m in HEADER.finditer(text) if _HEADER_HINT.search(text) else ():
        v = m.group(2)
        if REFERENCE.search(v) or SAMPLE.search(v) or not re.search(r"\d", v):
            if m.group(1) != "Basic":
                continue
        if m.group(1) == "Basic":
            try:
                login = base64.b64decode(v + "=" * (-len(v) % 4)).decode()
            except (binascii.Error, UnicodeDecodeError, ValueError):
                continue
            name, colon, password = login.partition(":")
            if not colon or not password or REFERENCE.search(password) or SAMPLE.search(password):
                continue
        elif not (len(v) >= 16 and re.search(r"[A-Za-z]", v) and re.search(r"\d", v)) or UUID.match(v):
            continue
        add(m.start(2), m.end(2), "header")
    lower = text.lower()
    if len(lower) != len(text):  # a character whose lower case is longer
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    seen = -1
    for at in sorted(_places(lower, _STEMS)):
        if at < seen:
            continue
        start, name = _name_before(text, at, at)
        seen = end = start + len(name)
        a = _ASSIGN.match(text, end)
        if not a or not secret_name(name.rstrip(".")):
            continue
        spans = _literal_at(text, a.end(), config)
        if not spans:
            continue
        value = "".join(text[lo:hi] for lo, hi in spans)
        if usable(value) and not HEADER.match(value) or phrase(name, value):
            for lo, hi in spans:
                add(lo, hi, "named", spans[0][0])
    for m in _FLAG.finditer(text) if "-" in text else ():
        if usable(m.group(2)):
            add(m.start(2), m.end(2), "flag")
    for m in _LOGIN_FLAG.finditer(text) if "-u" in text else ():
        if usable(m.group(2)):
            add(m.start(2), m.end(2), "flag")
    lines = {(text.rfind("\n", 0, at) + 1) for at in _places(lower, _REMARK_STEMS)}
    for lo in sorted(lines):
        hi = text.find("\n", lo)
        hi = hi if hi >= 0 else len(text)
        # The value ends the line and holds no colon, so the last colon is the one before it.
        m = _PHRASE.search(text, max(lo, text.rfind(":", lo, hi) - _REMARK_REACH), hi)
        if m and usable(m.group(1)) and re.search(r"\d", m.group(1)) and not m.group(1).endswith((".", ",")):
            add(m.start(1), m.end(1), "remark")
    return hits


def scan(text: str, config: bool) -> list[Hit]:
    """All secrets of a text in order; spans don't overlap.

    ``config``: unquoted values count, as in settings files.
    """
    hits = _open_hits(text, config)
    for lo, hi in _literals(text):
        if kind := _inside(text[lo:hi]):
            hits.append(Hit(lo, hi, f"encoded_{kind}", lo))
    for spans in _blocks(text):
        joined = "".join(text[lo:hi] for lo, hi in spans)
        if kind := _inside(joined):
            hits += [Hit(lo, hi, f"encoded_{kind}", spans[0][0]) for lo, hi in spans]
    return _joined(hits)


def _joined(hits: list[Hit]) -> list[Hit]:
    """The hits in order; those that overlap are one, reported where the first is."""
    out: list[Hit] = []
    for h in sorted(hits, key=lambda h: (h.start, -h.end)):
        if out and h.start < out[-1].end:
            if h.end > out[-1].end:
                out[-1] = Hit(out[-1].start, h.end, out[-1].kind, out[-1].at)
        else:
            out.append(h)
    return out


def scan_path(path: str) -> list[Hit]:
    """Secrets of a file's path: assigned values and logins in its segments."""
    hits = [Hit(m.start(), m.end(), "token", 0) for m in FORMAT.finditer(path)]
    for m in PATH_LOGIN.finditer(path):
        if usable(m.group(2)) or len(m.group(2)) >= 12:
            hits.append(Hit(m.start(2), m.end(2), "url_login", 0))
    for m in re.finditer(r"([\w\-]+)=([^/=&\s]{8,})", path):
        if secret_name(m.group(1)) and usable(m.group(2)):
            hits.append(Hit(m.start(2), m.end(2), "named", 0))
    return hits


def lines_of(text: str | None, path: str | None) -> list[tuple[int, str]]:
    """(line, kind) of each secret; line 0 is the path."""
    out = [(0, h.kind) for h in scan_path(path)] if path else []
    if text:
        config = bool(CONFIG_EXT.search(path or ""))
        out += [(text.count("\n", 0, h.at) + 1, h.kind) for h in scan(text, config)]
    return out


def _masked(text: str, hits: list[Hit], mask: str) -> str:
    out, last = [], 0
    for h in hits:
        out += [text[last : h.start], mask]
        last = h.end
    return "".join([*out, text[last:]])


def redact(text: str | None, path: str | None, mask: str = MASK) -> str | None:
    """The text with each secret value replaced by the mask."""
    return _masked(text, scan(text, bool(CONFIG_EXT.search(path or ""))), mask) if text else text


def path_spans(path: str) -> list[Hit]:
    """Secrets of a path in order; those that overlap are one."""
    return _joined(scan_path(path))


def redact_path(path: str | None, mask: str = MASK) -> str | None:
    """The path with each secret value replaced by the mask."""
    return _masked(path, path_spans(path), mask) if path else path


def found(files: DataFrame) -> DataFrame:
    """Distinct (id, line_no, kind) of all secrets of (id, module_path, content) rows.

    Null contents and paths hold none.  Repeated rows of an id give the same rows once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, kinds = [], [], []
            for key, path, text in zip(*(b[c].to_pylist() for c in ("id", "module_path", "content"))):
                for no, kind in set(lines_of(text, path)):
                    ids.append(key), nos.append(no), kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(nos, pa.int32()), pa.array(kinds, pa.string())], ["id", "line_no", "kind"])

    return files.select("id", "module_path", "content").mapInArrow(run, "id string, line_no int, kind string").distinct()


def rewritten(files: DataFrame) -> DataFrame:
    """(id, module_path, content, n_path, n_content) of every distinct id with a secret in either field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, path, text in zip(*(b[c].to_pylist() for c in ("id", "module_path", "content"))):
                in_path = path_spans(path) if path else []
                in_text = scan(text, bool(CONFIG_EXT.search(path or ""))) if text else []
                if in_path or in_text:
                    rows.append((key, _masked(path, in_path, MASK) if path else path, _masked(text, in_text, MASK) if text else text, len(in_path), len(in_text)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["id", "module_path", "content", "n_path", "n_content"])

    cols = ("module_path", "content", "n_path", "n_content")
    out = files.select("id", "module_path", "content").mapInArrow(run, "id string, module_path string, content string, n_path int, n_content int")
    return out.groupBy("id").agg(F.first(F.struct(*cols)).alias("r")).select("id", *(f"r.{c}" for c in cols))


def redacted(files: DataFrame) -> DataFrame:
    """(id, content, n_redacted) of every distinct id whose content holds a secret; paths are left to ``rewritten``."""
    return rewritten(files).where("n_content > 0").select("id", "content", F.col("n_content").alias("n_redacted"))
