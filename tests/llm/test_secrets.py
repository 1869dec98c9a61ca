import base64

import pytest

from lakeloom.llm import secrets as S

TOKEN = "ghp_" + "a1B2c3D4e5F6" * 3


def _lines(text, path="app/settings.py"):
    return sorted({n for n, _ in S.lines_of(text, path)})


@pytest.mark.parametrize("text", [
    f'x = "{TOKEN}"', 'password = "Hinge-quartz47!"', "const apiKey: &str = \"zFtTmXoj.bnEfE\";", '<add key="pwd" value="Kz6tfl92.CfMtq" />', 'url = "postgres://root:rudderOrbit1970@db/main"',
    'h = "Token f8837f1e10e9497b8605ad553be0e3ce70f2099b"', f'key = "{TOKEN[:11]}" + "{TOKEN[11:]}"', "# login for the box: deploy / manifestTicket2011", "args: --secret-key Escrow-fjord887!",
    "curl -u 'ci:vertexSummit1969' http://x", 'h = "Basic c3ZjOnVwd2VsbEtpb3NrMTk3Mg=="', f'blob = "{base64.b64encode(("token=" + TOKEN).encode()).decode()}"', f'hexed = "{("k: " + TOKEN).encode().hex()}"',
    f'twice = "{base64.b64encode(base64.b64encode(TOKEN.encode())).decode()}"', 'esc = "' + "".join(f"\\x{ord(c):02x}" for c in TOKEN) + '"', 'pct = "' + "".join(f"%{ord(c):02X}" for c in TOKEN) + '"',
])
def test_found(text):
    assert _lines("first line\n" + text) == [2]


@pytest.mark.parametrize("text", [
    'password = "${DB_PASSWORD}"', 'password = "REPLACE_ME"', 'password = "********"', 'password_hash = "$2b$12$ru4n1gZItWMoY5ZDxd69H9V3rzpKvv9NkfJcqT6WjqQh57vvaEKfT"', 'secret_name = "glade/prod/signing_key"', "token = next(limit, None)",
    'api_key = "ENC[AES256,1l69G+yZwbBITfN2OfZnitSazvE0EQHWoBWSBrMq=]"', 'token_url = "https://mail13.shard.invalid/oauth/token"', 'commit = "5e85b0e9bac7c1650453f9d7ebeb9b3e81bce11a"', 'max_tokens = "4902"', 'password_label = "Mot de passe oublié"',
    '# -----BEGIN CERTIFICATE-----\n# MIIB0123456789012345678901234567890123456789\n# -----END CERTIFICATE-----', 'job = "4049f0cc-8b94-4440-addf-b506c5a6c214"', "",
])
def test_not_found(text):
    assert _lines(text) == []


def _der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def test_key_containers():
    num = lambda n: _der(2, bytes([1]) * n)
    pkcs1 = _der(0x30, _der(2, b"\0"), *[num(64)] * 8)
    pkcs8 = _der(0x30, _der(2, b"\0"), _der(0x30, _der(6, b"\x2a\x03")), _der(4, b"x" * 40))
    assert S.key_container(pkcs1) == "pkcs1" and S.key_container(pkcs8) == "pkcs8"
    assert S.key_container(_der(0x30, _der(0x30, _der(6, b"\x2a")), _der(3, b"x" * 60))) is None  # a public key
    assert S.key_container(pkcs1[:-3]) is None and S.key_container(b"") is None
    assert _lines(f'k = "{base64.b64encode(pkcs8).decode()}"') == [1]


def test_redaction_keeps_the_rest():
    text = f'a = 1\npassword = "Hinge-quartz47!"  # kept\nurl = "amqp://u:folioEdict1963@h/x"\r\nz = "{TOKEN}"\n'
    got = S.redact(text, "a.py")
    assert got == text.replace("Hinge-quartz47!", "REDACTED").replace("folioEdict1963", "REDACTED").replace(TOKEN, "REDACTED")
    assert S.redact(None, None) is None and S.redact("", "") == ""


def test_path_and_table(spark):
    rows = [("1", "export/access_token=de9e7fa8bcc198c6df8f27f9afc2a1f21d61fdc5/a.yaml", "x: 1"), ("1", "export/access_token=de9e7fa8bcc198c6df8f27f9afc2a1f21d61fdc5/a.yaml", "x: 1"), ("2", None, None), ("3", "deploy/git@host/a.ini", ""), ("4", "a.env", f"K={TOKEN}\n" * 2)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "id string, module_path string, content string, kind string")
    assert {(r["id"], r["line_no"]) for r in S.found(df).collect()} == {("1", 0), ("4", 1), ("4", 2)}
    assert [r["id"] for r in S.redacted(df).collect()] == ["4"]
    assert S.found(df.limit(0)).count() == 0


def _nested(text, layers):
    for _ in range(layers):
        text = base64.b64encode(text.encode()).decode()
    return text


LONG_KEY = "aZ3-kQ9/" * 700
PKCS12 = _der(0x30, _der(2, b"\3"), _der(0x30, b"\x5a" * 60_000))
REMARK = "# login for the box: deploy / manifestTicket2011"


@pytest.mark.parametrize("text", [
    'k = "' + base64.b64encode(b"\xfe\xed\xfe\xed" + bytes(range(256)) * 400).decode() + '"', f'k = "{base64.b64encode(PKCS12).decode()}"',  # literals over 75 KB
    "x();" * 1500 + REMARK, "// " + "y" * 3990 + " " + REMARK, f'password = "{LONG_KEY}"', f"secret = '''{LONG_KEY}'''",
    'api_key                    =                    "Hinge-quartz47!"', "password\t\t\t\t\t\t\t\t:\t\t\t\t\t\t\t\tHinge-quartz47!", '<add key="pwd"          value  =         "Kz6tfl92.CfMtq" />',
    f'b = "{_nested(TOKEN, 9)}"', 'p = "%' + "25" * 5000 + "67" + TOKEN[1:] + '"',
])
def test_found_at_any_length(text):
    assert _lines("first line\n" + text, "app/settings.yaml") == [2]
    assert TOKEN not in S.redact(text, "a.yaml") and "Hinge" not in S.redact(text, "a.yaml") and "manifestTicket" not in S.redact(text, "a.yaml") and LONG_KEY not in S.redact(text, "a.yaml")


@pytest.mark.parametrize("text", ["password" + " " * 200_000 + "x", "x = '" + "%25" * 60_000 + "'", "p = \"" + "\\x5c" + "x5c" * 60_000 + '"', "login " * 40_000, "password = '" * 20_000])
def test_long_texts_end(text):
    assert _lines(text, "app/settings.yaml") == []


def test_redacted_query_covers_the_path(spark, tmp_path):
    from lakeloom.llm import queries

    secret = "de9e7fa8bcc198c6df8f27f9afc2a1f21d61fdc5"
    rows = [("1", f"export/access_token={secret}/a.yaml", "x: 1"), ("1", f"export/access_token={secret}/a.yaml", "x: 1"), ("2", f"a/token={TOKEN}/b.env", f"K={TOKEN}\n"), ("3", "deploy/oauth2:Hinge-quartz47@host/x", None), ("4", "a.env", f"K={TOKEN}\n"), ("5", None, None), ("6", "a.py", "x = 1")]
    spark.createDataFrame(rows, "id string, module_path string, content string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["id"]: (r["module_path"], r["content"], r["n_redacted"]) for r in queries.p2_redacted(spark, str(tmp_path)).collect()}
    assert got == {
        "1": ("export/access_token=REDACTED/a.yaml", "x: 1", 1), "2": ("a/token=REDACTED/b.env", "K=REDACTED\n", 2),
        "3": ("deploy/oauth2:REDACTED@host/x", None, 1), "4": ("a.env", "K=REDACTED\n", 1),
    }


def _lines_of_base64(data, width=64):
    text = base64.b64encode(data).decode()
    return [text[i : i + width] for i in range(0, len(text), width)]


PKCS8 = _der(0x30, _der(2, b"\0"), _der(0x30, _der(6, b"\x2a\x03")), _der(4, bytes(range(200))))


@pytest.mark.parametrize("text", [
    "key: |\n" + "\n".join("  " + x for x in _lines_of_base64(PKCS8)) + "\nnext: 1\n", "K = (\n" + "\n".join(f'    "{x}"' for x in _lines_of_base64(PKCS8)) + "\n)\n",
    "# old\n" + "\n".join("# " + x for x in _lines_of_base64(PKCS8)) + "\n# end\n",
])
def test_encodings_over_several_lines(text):
    assert _lines(text, "a.yaml") == [2]
    assert not any(x in S.redact(text, "a.yaml") for x in _lines_of_base64(PKCS8))


def test_first_line_behind_its_quote():
    text = 'K = """' + "\n".join(_lines_of_base64(PKCS8)) + '"""\nprint(1)\n'
    assert _lines(text) == [1] and S.redact(text, "a.py").endswith('REDACTED"""\nprint(1)\n')


def test_stores_by_their_fields():
    entry = lambda tag, body: tag.to_bytes(4, "big") + b"\0\1a" + bytes(8) + body
    cert = b"\0\5X.509" + (9).to_bytes(4, "big") + b"c" * 9
    head = b"\xfe\xed\xfe\xed\0\0\0\2"
    assert S.key_container(head + b"\0\0\0\1" + entry(2, cert)) is None
    assert S.key_container(head + b"\0\0\0\2" + entry(2, cert) + entry(1, (40).to_bytes(4, "big") + b"k" * 40)) == "jks"
    safe = lambda oid: _der(0x30, _der(2, b"\3"), _der(0x30, _der(6, bytes.fromhex("2a864886f70d010701")), _der(0xA0, _der(4, _der(0x30, _der(0x30, _der(6, bytes.fromhex(oid)), _der(0xA0, b"x" * 40)))))))
    assert S.key_container(safe("2a864886f70d010c0a0102")) == "pkcs12" and S.key_container(safe("2a864886f70d010c0a0103")) is None
    putty = lambda n: f"PuTTY-User-Key-File-2: ssh-rsa\nEncryption: {n}\nComment: x\nPublic-Lines: 1\nAAAA\nPrivate-Lines: 1\nAAAAgQ==\nPrivate-MAC: 00\n".encode()
    assert S.key_container(putty("none")) == "putty" and S.key_container(putty("aes256-cbc")) is None
    assert S.key_container(b"openssh-key-v1\0\0\0\0\4none") is None


def test_pass_phrases():
    assert _lines('passphrase = "correct horse battery staple"') == [1]
    assert _lines('password = "enter your new password"') == [] and _lines('title = "correct horse battery staple"') == []


def test_overlapping_spans_are_one():
    text = f'url = "https://u:{TOKEN}-tail9@h/x"'
    assert "tail9" not in S.redact(text, "a.py") and S.redact(text, "a.py").count("REDACTED") == 1
