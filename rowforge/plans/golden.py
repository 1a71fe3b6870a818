"""Texts that each format takes and refuses, written down one by one: the oracle of the format checks.

None of them is made from the patterns under test.
"""

from __future__ import annotations

_MD5 = "d41d8cd98f00b204e9800998ecf8427e"
_SHA1 = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
_SHA384 = "38b060a751ac96384cd9327eb1b1e36a21fdb71114be07434c0cc7bf63f6e1da274edebfe76f65fbd51ad2f14898b95b"
_SHA512 = "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e"


def _hash(value: str) -> tuple[list[str], list[str]]:
    """A digest of one length: its digits in either case; another length, other characters or marks are refused."""
    n = len(value)
    good = [value, value.upper(), value.title(), "0" * n, "f" * n, "F" * n, "9" * n, ("aB" * n)[:n], value[::-1], "1" + value[1:]]
    bad = ["", value[:-1], value + "0", "g" + value[1:], value[:-1] + " ", " " + value[1:], value + "\n", "0x" + value, "0x" + value[2:], value[: n // 2] + "-" + value[n // 2 + 1 :], value * 2]
    return good, bad


def _uuid(version: str) -> tuple[list[str], list[str]]:
    """Texts of one version with each variant digit, and what differs from them in one thing."""
    v = version
    good = [f"f47ac10b-58cc-{v}372-{x}567-0e02b2c3d479" for x in "89abAB"]
    good += [f"00000000-0000-{v}000-8000-000000000000", f"FFFFFFFF-FFFF-{v}FFF-BFFF-FFFFFFFFFFFF", f"F47AC10B-58cc-{v}372-a567-0E02B2C3D479", f"01234567-89ab-{v}def-9123-456789abcdef"]
    other = "1" if v != "1" else "2"
    one = f"f47ac10b-58cc-{v}372-a567-0e02b2c3d479"
    bad = ["", one.replace("-", ""), one + "0", one[:-1], f"f47ac10b-58cc-{other}372-a567-0e02b2c3d479", f"f47ac10b-58cc-{v}372-c567-0e02b2c3d479", f"f47ac10b-58cc-{v}372-7567-0e02b2c3d479", "g" + one[1:], "{" + one + "}", one + "\n", "f47ac10b58cc-0000-0000-0000-0e02b2c3d479", "00000000-0000-0000-0000-000000000000"]
    return good, bad


_EMAILS = (
    ["a@b.c", "user@example.com", "first.last@example.co.uk", "user+tag@example.org", "ünal@exämple.de", "用户@例子.公司", "a!b@c.d", "\"quoted\"@example.com", "user@sub.sub.example.com", "1@2.3", "a..b@example.com", "user@-example.com"],
    ["", "user", "user@", "@example.com", "user@example", "a b@example.com", "user@exam ple.com", "a@b@c.de", "user@example.", "a\u00a0b@c.de", "user@.", "user@example.com\n", " user@example.com"],
)

#: name: (taken, refused)
GOLDEN: dict[str, tuple[list[str], list[str]]] = {
    "alpha": (["a", "Z", "abc", "ABC", "aBc", "hello", "HELLO", "Order", "abcdefghijklmnopqrstuvwxyz", "zzZZ"], ["", "a1", "1", "a b", " a", "a ", "a-b", "é", "a\n", "a_b", "ß", "a.b"]),
    "alphanumeric": (["a", "1", "a1", "1a", "ABC123", "007", "Z9", "abc", "000", "x2y2"], ["", "a-1", "a_1", "a b", "ü1", "1.0", "+1", "a1 ", "a1\n", "٣", "#1"]),
    "base64": (["SGVsbG8=", "YQ==", "YWI=", "YWJj", "a+/b", "AAAA", "0123456789", "=", "==", "ab+/cd==", "Zm9vYmFy"], ["", "a b", "YQ===", "_-", "a=b", "YW-j", "YWJj\n", "é", "a,b", "=a", "a!"]),
    "base64_url": (["SGVsbG8", "YQ", "YQ==", "a_b-c", "AAAA", "-_-_", "0123456789", "Zm9vYmFy", "abc=", "x"], ["", "+/", "a+b", "a/b", "a b", "YQ===", "a=b", "abc\n", "é", "a.b", "=a"]),
    "bic": (["DEUTDEFF", "DEUTDEFF500", "BNPAFRPP", "BNPAFRPPXXX", "CHASUS33", "HSBCGB2L", "NEDSZAJJXXX", "ABCDEF00", "ABCDEFG1ABC", "UBSWCHZH80A"], ["", "deutdeff", "DEUTDEF", "DEUTDEFF5", "DEUTDEFF50", "DEUTDEFF5000", "DEU1DEFF", "DEUT1EFF", "DEUTDEFF-50", " DEUTDEFF", "DEUTDEFF\n", "DEUTDEfF"]),
    "cuid": (["c" + "a" * 24, "cjld2cjxh0000qzrmn831i7rn", "ch72gsb320000udocl363eofy", "cixf02ym000001b66m45ae4k8", "c" + "0" * 24, "c" + "z9" * 12, "c" + "a" * 30, "ckopqwooh000001la8mbi2im9", "cl9ebqhxk00003b600tymydho", "c123456789012345678901234"], ["", "c", "c" + "a" * 23, "d" + "a" * 24, "C" + "a" * 24, "c" + "A" * 24, "c" + "a" * 23 + "-", "a" * 25, " c" + "a" * 24, "c" + "a" * 24 + "\n", "1" + "a" * 24]),
    "cuid2": (["a" * 25, "tz4a98xxat96iws9zmbrgj3a0", "z" + "0" * 24, "pfh0haxfpzowht3oi213cqos1", "a" + "1b" * 12, "b" * 32, "m" + "9" * 25, "nc6bzmkmd014706rfda898to0", "c" + "a" * 24, "xyz" + "0" * 22], ["", "a", "a" * 24, "1" + "a" * 24, "A" + "a" * 24, "a" * 24 + "A", "a" * 24 + "-", "a" * 24 + "_", " " + "a" * 25, "a" * 25 + "\n", "0" * 25]),
    "domain": (["example.com", "a.b.example.com", "x--y.org", "1.example.net", "xn--bcher-kva.example", "EXAMPLE.COM", "a-b.co", "123.de", "a.io", "my-site.travel"], ["", "example", "-a.com", "a-.com", "a.b", "a.c0m", ".com", "a..com", "a.com.", "a_b.com", "a b.com", "http://a.com", "bücher.de", "a.com\n", "a.123"]),
    "email": _EMAILS,
    "email_unicode": _EMAILS,
    "email_html5": (["a@b", "user@example", "user@example.com", "user.name@ex-ample.com", "a+b@c.d", "!#$%&'*+/=?^_`{|}~-@x.y", "a..b@c", ".a@c", "a.@c", "1@2", "a@" + "x" * 63], ["", "a", "a@", "@b", "a@-b", "a@b-", "a@b..c", "ü@x.y", "a b@c", "a@b.", "a@" + "x" * 64, "a@b\n", "\"a\"@b"]),
    "email_rfc5322": (["a@b.cd", "user.name@example.com", "\"ab\"@x.yz", "\"a..b\"@x.yz", "a@[10.0.0.1]", "a+b@x.yz", "!#$%@x.yz", "a@sub.example.org", "a@[255.255.255.255]", "1@2.io", "o'brien@example.ie"], ["", "a", "a@b", "a..b@x.yz", ".a@x.yz", "a.@x.yz", "a@b.c", "a@[256.0.0.1]", "a@-b.cd", "\"a b\"@x.yz", "a b@x.yz", "a@x..yz", "a@b.cd\n", "ü@x.yz"]),
    "epoch": (["0", "1", "1700000000", "1700000000000", "9999999999", "00", "007", "253402300799", "42", "1" * 30], ["", "-1", "1.0", "1e9", "+1", " 1", "1 ", "1\n", "abc", "0x10", "1_000"]),
    "hash_md5": _hash(_MD5), "hash_sha1": _hash(_SHA1), "hash_sha256": _hash(_SHA256), "hash_sha384": _hash(_SHA384), "hash_sha512": _hash(_SHA512),
    "hex": (["0", "f", "F", "deadbeef", "DEADBEEF", "DeadBeef", "0123456789abcdef", "00", "1", "a1B2"], ["", "g", "0x1", "#fff", "a b", "-1", "1.0", "xyz", "ff\n", "é", " ff"]),
    "hex_color": (["#fff", "#FFF", "#000", "#ffff", "#123456", "#abcdef", "#ABCDEF", "#12345678", "#FFFFFF80", "#a1B2c3"], ["", "#", "#ff", "#12345", "#1234567", "#123456789", "fff", "#ggg", "# fff", "#fff\n", "##fff", "rgb(0,0,0)"]),
    "hostname": (["a", "localhost", "example.com", "a-b.c", "1", "127.0.0.1", "my-host", "A.B.C", "x--y", "a" * 63 + ".b", "a" * 100], ["", "-a", "a-", "a..b", ".a", "a.", "a_b", "a b", "a" * 254, "é", "a-.b", "a\n", "a.-b"]),
    "ip": (["1.2.3.4", "0.0.0.0", "255.255.255.255", "::", "::1", "2001:db8::1", "fe80::1%eth0", "::ffff:10.0.0.1", "1:2:3:4:5:6:7:8", "10.0.0.1"], ["", "x", "1.2.3", "256.1.1.1", "1.2.3.4.5", "1::2::3", "12345::", "1:2:3", ":::", "1.2.3.4\n", "1.2.3.4/8", "g::1"]),
    "ip_v4": (["0.0.0.0", "1.2.3.4", "10.0.0.1", "127.0.0.1", "192.168.1.1", "255.255.255.255", "001.002.003.004", "8.8.8.8", "172.16.254.1", "99.100.199.200"], ["", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1.2.3.256", "1.2.3.a", "1..2.3", "1.2.3.4 ", "1.2.3.-4", "1.2.3.4\n", "::1", "1.2.3.4/8", "1234.1.1.1"]),
    "ip_v4_cidr": (["10.0.0.0/8", "0.0.0.0/0", "192.168.0.0/16", "1.2.3.4/32", "172.16.0.0/12", "255.255.255.255/1", "10.1.2.3/24", "8.8.8.8/31", "1.1.1.1/9", "100.64.0.0/10"], ["", "10.0.0.0", "10.0.0.0/33", "10.0.0.0/-1", "10.0.0.0/", "/8", "256.0.0.0/8", "10.0.0/8", "10.0.0.0/8/8", "10.0.0.0/a", "10.0.0.0/8\n", "::/8", "10.0.0.0/99"]),
    "ip_v6": (["::", "::1", "1::", "1:2:3:4:5:6:7:8", "2001:db8::1", "2001:DB8:0:0:8:800:200C:417A", "fe80::1%eth0", "::ffff:10.0.0.1", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6::8", "1::3:4:5:6:7:8", "64:ff9b::192.0.2.33"], ["", ":", ":::", "1", "1:2:3", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:", ":1:2:3:4:5:6:7", "::1\n", "1.2.3.4", "::ffff:256.0.0.1", "::1/64", " ::1"]),
    "ip_v6_cidr": (["::/0", "::1/128", "2001:db8::/32", "fe80::/10", "1:2:3:4:5:6:7:8/64", "::ffff:0:0/96", "FC00::/7", "2001:db8::1/127", "1::/1", "abcd::/99"], ["", "::", "::1", "::/129", "::/-1", "::/", "/64", "::/1/2", "g::/3", "1.2.3.4/8", "::/a", "1::2::3/64", "::/64\n", "::/1000"]),
    "iso_date": (["2024-01-01", "2024-12-31", "1970-01-01", "0000-01-01", "9999-12-31", "2024-02-29", "2023-02-31", "2024-06-30", "2000-10-10", "1999-11-09"], ["", "2024-13-01", "2024-00-01", "2024-01-00", "2024-01-32", "2024-1-01", "2024-01-1", "20240101", "24-01-01", "2024/01/01", "2024-01-01T00:00:00", "2024-01-01\n", "-2024-01-01"]),
    "iso_date_time": (["2024-02-03T04:05:06", "2024-02-03T00:00:00", "2024-02-03T23:59:59", "2024-02-03T04:05:06.1", "2024-02-03T04:05:06.123", "2024-02-03T04:05:06.123456789", "1970-01-01T00:00:00", "9999-12-31T23:59:59.999", "2024-02-31T10:10:10", "0001-01-01T01:01:01"], ["", "2024-02-03", "2024-02-03T24:00:00", "2024-02-03T04:60:06", "2024-02-03T04:05:60", "2024-02-03T04:05", "2024-02-03 04:05:06", "2024-02-03T04:05:06Z", "2024-02-03T04:05:06.", "2024-02-03T04:05:06+01:00", "2024-13-03T04:05:06", "2024-02-03t04:05:06", "2024-02-03T04:05:06\n"]),
    "iso_duration": (["P1Y", "P1M", "P1D", "P1Y2M3D", "PT1H", "PT1M", "PT1S", "PT1.5S", "P1Y2M3DT4H5M6S", "P0D", "PT36H", "P10Y", "P1DT12H"], ["", "P", "PT", "1Y", "P1", "P1H", "PT1Y", "P1D2M", "P-1D", "P1.5Y", "p1y", "P1Y\n", "P1W", "PT1.S"]),
    "iso_time": (["00:00:00", "23:59:59", "04:05:06", "12:00:00", "04:05:06.1", "04:05:06.123", "04:05:06.123456789", "19:19:19", "20:00:01", "09:09:09.0"], ["", "24:00:00", "04:60:00", "04:00:60", "4:05:06", "04:05", "04:05:06.", "04:05:06Z", "04-05-06", "040506", "T04:05:06", "04:05:06\n", "04:05:06,5"]),
    "iso_timestamp": (["2024-02-03T04:05:06Z", "2024-02-03T04:05:06.1Z", "2024-02-03T04:05:06+00:00", "2024-02-03T04:05:06+01:00", "2024-02-03T04:05:06-23:59", "2024-02-03T04:05:06.123456Z", "1970-01-01T00:00:00Z", "9999-12-31T23:59:59.999+14:00", "2024-02-31T10:10:10Z", "2024-02-03T04:05:06.5-05:30"], ["", "2024-02-03T04:05:06", "2024-02-03T04:05:06z", "2024-02-03T04:05:06+24:00", "2024-02-03T04:05:06+01:60", "2024-02-03T04:05:06+0100", "2024-02-03T04:05:06+01", "2024-02-03T24:05:06Z", "2024-02-03 04:05:06Z", "2024-02-03Z", "2024-00-03T04:05:06Z", "2024-02-03T04:05:06Z\n", "2024-02-03T04:05Z"]),
    "iso_week": (["2024-W01", "2024-W09", "2024-W10", "2024-W19", "2024-W49", "2024-W52", "2024-W53", "1970-W30", "0000-W01", "9999-W50"], ["", "2024-W00", "2024-W54", "2024-W60", "2024W01", "2024-W1", "2024-w01", "24-W01", "2024-W001", "2024-W01-1", "2024-W01\n", "2024-01"]),
    "jwt": (["a.b.c", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abc", "A.B.C", "1.2.3", "a-b.c_d.e", "_._._", "-.-.-", "aaa.bbb.ccc", "x1.y2.z3", "eyJ0.eyJ1.s-_g"], ["", "a", "a.b", "a.b.c.d", "a..c", ".b.c", "a.b.", "a.b.c=", "a b.c.d", "a.b.c\n", "a.b+.c", "a/b.c.d"]),
    "mac": (["00:1A:2b:3C:4d:5E", "00-1A-2b-3C-4d-5E", "ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00", "00:1A:2b:3C:4d:5E:6F:70", "00-1A-2b-3C-4d-5E-6F-70", "aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "01:23:45:67:89:ab", "ab:cd:ef:01:23:45:67:89"], ["", "00:1A", "00:1A:2b:3C:4d", "00:1A:2b:3C:4d:5E:6F", "001A2b3C4d5E", "0:1:2:3:4:5", "gg:1A:2b:3C:4d:5E", "00:1A:2b:3C:4d:5E:", "00.1A.2b.3C.4d.5E", "00:1A:2b:3C:4d:5E\n", "00 1A 2b 3C 4d 5E", "00:1A:2b:3C:4d:5E:6F:70:81"]),
    "mac_v48": (["00:1A:2b:3C:4d:5E", "00-1A-2b-3C-4d-5E", "ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00", "aa:bb:cc:dd:ee:ff", "AA-BB-CC-DD-EE-FF", "01:23:45:67:89:ab", "DE:AD:BE:EF:00:01", "0a-0b-0c-0d-0e-0f", "12:34:56:78:9A:BC"], ["", "00:1A", "00:1A:2b:3C:4d:5E:6F:70", "001A2b3C4d5E", "00:1A:2b:3C:4d", "0:1:2:3:4:5", "gg:1A:2b:3C:4d:5E", "00:1A:2b:3C:4d:5E:", "00.1A.2b.3C.4d.5E", "00:1A:2b:3C:4d:5E\n", "00 1A 2b 3C 4d 5E"]),
    "mac_v64": (["00:1A:2b:3C:4d:5E:6F:70", "00-1A-2b-3C-4d-5E-6F-70", "ff:ff:ff:ff:ff:ff:ff:ff", "00:00:00:00:00:00:00:00", "aa:bb:cc:dd:ee:ff:00:11", "AA-BB-CC-DD-EE-FF-00-11", "01:23:45:67:89:ab:cd:ef", "DE:AD:BE:EF:00:01:02:03", "0a-0b-0c-0d-0e-0f-1a-1b", "12:34:56:78:9A:BC:DE:F0"], ["", "00:1A:2b:3C:4d:5E", "00:1A:2b:3C:4d:5E:6F", "001A2b3C4d5E6F70", "00:1A:2b:3C:4d:5E:6F:7G", "00:1A:2b:3C:4d:5E:6F:70:81", "00:1A:2b:3C:4d:5E:6F:", ":1A:2b:3C:4d:5E:6F:70", "00.1A.2b.3C.4d.5E.6F.70", "00:1A:2b:3C:4d:5E:6F:70\n", "0:1:2:3:4:5:6:7"]),
    "mime": (["text/html", "text/plain", "image/svg+xml", "application/json", "application/vnd.api+json", "x-y/z", "a/b", "application/vnd.ms-excel", "video/mp4", "audio/x-wav", "font/woff2"], ["", "text", "text/", "/html", "text/html; charset=utf-8", "text html", "a.b/c", "text//html", "-a/b", "a/-b", "text/html\n", "te xt/html"]),
    "nanoid": (["V1StGXR8_Z5jdHi6B-myT", "a" * 21, "0" * 21, "_" * 21, "-" * 21, "A1b2C3d4E5f6G7h8I9j0K", "abcdefghijklmnopqrstu", "ABCDEFGHIJKLMNOPQRSTU", "012345678901234567890", "Uakgb_J5m9g-0JDMbcJqL"], ["", "a" * 20, "a" * 22, "V1StGXR8_Z5jdHi6B-my!", "a" * 20 + " ", " " + "a" * 20, "a" * 20 + "+", "a" * 20 + ".", "é" * 21, "a" * 21 + "\n", "a" * 20 + "/"]),
    "numeric": (["0", "1", "42", "007", "1234567890", "9" * 30, "00", "10", "2024", "5550100"], ["", "-1", "+1", "1.0", "1e5", "1,000", " 1", "1 ", "a", "1\n", "٣", "0x1"]),
    "octal": (["0", "7", "755", "644", "0644", "01234567", "777", "10", "00", "1"], ["", "8", "9", "0o7", "78", "a", "-7", "7.0", " 7", "7\n", "0x7"]),
    "phone": (["+14155550100", "+442071838750", "+4930123456", "+12", "+919876543210", "+123456789012345", "+33123456789", "+81312345678", "+861012345678", "+99"], ["", "+", "+1", "14155550100", "+0123456", "+1234567890123456", "+1 415 555 0100", "+1-415-555-0100", "(415) 555-0100", "+1415555a100", "+14155550100\n", "++1415"]),
    "semver": (["1.2.3", "0.0.0", "10.20.30", "1.2.3-rc.1", "1.2.3+build.5", "1.2.3-rc.1+b.5", "01.2.3", "1.0.0-alpha", "999.999.999", "1.2.3-0"], ["", "1", "1.2", "v1.2.3", "1.2.3.4", "1.2.3-", "1.2.3+", "1.2.3-a-b", "1.2.x", "a.b.c", "1.2.3 ", "1.2.3\n", "-1.2.3"]),
    "slug": (["a", "order", "order-1", "a-b-c", "1", "2024-01-01", "hello-world", "x1-y2", "0", "long-slug-with-many-parts"], ["", "Order", "a--b", "-a", "a-", "a_b", "a b", "é", "a.b", "a\n", "-", "a-B"]),
    "ulid": (["01ARZ3NDEKTSV4RRFFQ69G5FAV", "0" * 26, "Z" * 26, "7ZZZZZZZZZZZZZZZZZZZZZZZZZ", "01BX5ZZKBKACTAV9WEVGEMMVRZ", "01G65Z755AFWAKHE12NY0CQ9FH", "ABCDEFGHJKMNPQRSTVWXYZ0123", "01F8MECHZX3TBDSZ7XRADM79XE", "9" * 26, "8ZZZZZZZZZZZZZZZZZZZZZZZZZ"], ["", "01arz3ndektsv4rrffq69g5fav", "01ARZ3NDEKTSV4RRFFQ69G5FA", "01ARZ3NDEKTSV4RRFFQ69G5FAVX", "01ARZ3NDEKTSV4RRFFQ69G5FAI", "01ARZ3NDEKTSV4RRFFQ69G5FAL", "01ARZ3NDEKTSV4RRFFQ69G5FAO", "01ARZ3NDEKTSV4RRFFQ69G5FAU", "01ARZ3NDEKTSV4RRFFQ69G5FA-", " 1ARZ3NDEKTSV4RRFFQ69G5FAV", "01ARZ3NDEKTSV4RRFFQ69G5FAV\n"]),
    "url": (["https://example.com", "http://x", "ftp://x/y", "x://y", "a+b://c", "HTTP://X", "file:///etc/hosts", "ws://localhost:8080/a?b=c#d", "s3://bucket/key", "custom.scheme://z", "https://münchen.de"], ["", "example.com", "://x", "http:/x", "http://", "http://a b", "1http://x", "http//x", " http://x", "http:// ", "http://x\n", "-a://b", "mailto:a@b.c"]),
    "url_http": (["http://x", "https://x", "http://example.com", "https://example.com/a/b?c=d#e", "http://localhost:80", "https://1.2.3.4", "http://user:pw@x.y", "http://[::1]/", "https://münchen.de", "http://-"], ["", "ftp://x", "HTTP://x", "http://", "https://", "http:/x", "http://a b", "httpss://x", "x http://y", "http://x\n", "//x", "example.com"]),
    "url_https": (["https://x", "https://example.com", "https://example.com/a/b?c=d#e", "https://localhost:443", "https://1.2.3.4", "https://user:pw@x.y", "https://[::1]/", "https://münchen.de", "https://-", "https://x/%20"], ["", "http://x", "HTTPS://x", "https://", "https:/x", "https://a b", "ftp://x", "x https://y", "https://x\n", "//x", "example.com"]),
    "uuid": (["00000000-0000-0000-0000-000000000000", "f47ac10b-58cc-4372-a567-0e02b2c3d479", "F47AC10B-58CC-4372-A567-0E02B2C3D479", "ffffffff-ffff-ffff-ffff-ffffffffffff", "01234567-89ab-cdef-0123-456789abcdef", "f47ac10b-58cc-1372-a567-0e02b2c3d479", "f47ac10b-58cc-7372-c567-0e02b2c3d479", "f47AC10b-58cc-4372-a567-0E02b2c3d479", "f47ac10b-58cc-0372-0567-0e02b2c3d479", "12345678-1234-1234-1234-123456789012"], ["", "0", "f47ac10b58cc4372a5670e02b2c3d479", "f47ac10b-58cc-4372-a567-0e02b2c3d47", "f47ac10b-58cc-4372-a567-0e02b2c3d4790", "g47ac10b-58cc-4372-a567-0e02b2c3d479", "{f47ac10b-58cc-4372-a567-0e02b2c3d479}", "f47ac10b-58cc-4372-a567", "f47ac10b_58cc_4372_a567_0e02b2c3d479", "f47ac10b-58cc-4372-a567-0e02b2c3d479\n", " f47ac10b-58cc-4372-a567-0e02b2c3d479", "f47ac10-b58cc-4372-a567-0e02b2c3d479"]),
    **{f"uuid_v{n}": _uuid(str(n)) for n in range(1, 9)},
    "json_string": (["{}", "[]", "1", "-1.5e3", "true", "null", '"x"', '{"a":1,"a":2}', " [1, 2] ", '{"a": {"b": [null, false]}}', '"\\u00e9"', "0"], ["", "{invalid}", "[1,]", "{\"a\":1,}", "NaN", "Infinity", "01", "1 2", "'x'", "undefined", "\"x", "{a: 1}", "+1", ".5"]),
}
