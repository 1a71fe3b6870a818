"""Checks of whole strings against formats: identifiers, network addresses, codes with check digits, dates as text."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import SPACE, Check, on_strings, utf16_length

#: Parts that several patterns share.
_OCTET = r"((25[0-5]|(2[0-4]|1?\d)?\d)\.){3}(25[0-5]|(2[0-4]|1?\d)?\d)"
_DATE = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?"
_UUID = "(?i)[0-9a-f]{8}-[0-9a-f]{4}-%s[0-9a-f]{3}-%s[0-9a-f]{3}-[0-9a-f]{12}"
_LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?"
_MAIL = rf"[^{SPACE}@]+@[^{SPACE}@]+\.[^{SPACE}@]+"

#: Name, pattern of the whole string, message.
PATTERNS: dict[str, tuple[str, str]] = {
    "alpha": ("[a-zA-Z]+", "must contain only letters"),
    "alphanumeric": ("[a-zA-Z0-9]+", "must contain only letters and numbers"),
    "base64": ("(?:[A-Za-z0-9+/]+={0,2}|={1,2})", "must be a valid base64 string"),
    "base64_url": ("(?:[A-Za-z0-9_-]+={0,2}|={1,2})", "must be a valid base64url string"),
    "bic": ("[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?", "must be a valid BIC/SWIFT code"),
    "cuid": ("c[a-z0-9]{24,}", "must be a valid CUID"),
    "cuid2": ("[a-z][a-z0-9]{24,}", "must be a valid CUID2"),
    "domain": (rf"(?:{_LABEL}\.)+[a-zA-Z]{{2,}}", "must be a valid domain"),
    "email": (_MAIL, "must be a valid email"),
    "email_html5": (r"[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*", "must be a valid email"),
    "email_rfc5322": (
        r"(?:[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-zA-Z0-9!#$%&'*+/=?^_`{|}~-]+)*|\"(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21\x23-\x5b\x5d-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])*\")@(?:(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]*[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}"
        r"|\[(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?|[a-zA-Z0-9-]*[a-zA-Z0-9]:(?:[\x01-\x08\x0b\x0c\x0e-\x1f\x21-\x5a\x53-\x7f]|\\[\x01-\x09\x0b\x0c\x0e-\x7f])+)\])",
        "must be a valid email",
    ),
    "email_unicode": (_MAIL, "must be a valid email"),
    "epoch": (r"\d+", "must be a valid epoch timestamp"),
    "hash_md5": ("[0-9a-fA-F]{32}", "must be a valid MD5 hash"),
    "hash_sha1": ("[0-9a-fA-F]{40}", "must be a valid SHA-1 hash"),
    "hash_sha256": ("[0-9a-fA-F]{64}", "must be a valid SHA-256 hash"),
    "hash_sha384": ("[0-9a-fA-F]{96}", "must be a valid SHA-384 hash"),
    "hash_sha512": ("[0-9a-fA-F]{128}", "must be a valid SHA-512 hash"),
    "hex": ("[0-9a-fA-F]+", "must be a valid hexadecimal string"),
    "hex_color": ("#([0-9a-fA-F]{3,4}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})", "must be a valid hex color"),
    "ip_v6": (
        r"(?i)(?:([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|([0-9a-f]{1,4}:){1,7}:|([0-9a-f]{1,4}:){1,6}(:[0-9a-f]{1,4}){1,1}|([0-9a-f]{1,4}:){1,5}(:[0-9a-f]{1,4}){1,2}"
        r"|([0-9a-f]{1,4}:){1,4}(:[0-9a-f]{1,4}){1,3}|([0-9a-f]{1,4}:){1,3}(:[0-9a-f]{1,4}){1,4}|([0-9a-f]{1,4}:){1,2}(:[0-9a-f]{1,4}){1,5}|([0-9a-f]{1,4}:){1,1}(:[0-9a-f]{1,4}){1,6}"
        r"|:((:[0-9a-f]{1,4}){1,7}|:)|fe80:(:[0-9a-f]{0,4}){0,4}%[0-9a-z]+|::(ffff(:0{1,4})?:)?((25[0-5]|(2[0-4]|1?\d)?\d)\.){3}(25[0-5]|(2[0-4]|1?\d)?\d)"
        r"|([0-9a-f]{1,4}:){1,4}:((25[0-5]|(2[0-4]|1?\d)?\d)\.){3}(25[0-5]|(2[0-4]|1?\d)?\d))",
        "must be a valid IPv6 address",
    ),
    "iso_date": (_DATE, "must be a valid ISO date"),
    "iso_date_time": (f"{_DATE}T{_TIME}", "must be a valid ISO date-time"),
    "iso_time": (_TIME, "must be a valid ISO time"),
    "iso_timestamp": (rf"{_DATE}T{_TIME}(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)", "must be a valid ISO timestamp"),
    "iso_week": (r"\d{4}-W(?:0[1-9]|[1-4]\d|5[0-3])", "must be a valid ISO week"),
    "jwt": (r"[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "must be a valid JWT"),
    "mac": ("([0-9a-fA-F]{2}[:-]){5}(([0-9a-fA-F]{2}[:-]){2})?[0-9a-fA-F]{2}", "must be a valid MAC address"),
    "mac_v48": ("([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", "must be a valid MAC-48 address"),
    "mac_v64": ("([0-9a-fA-F]{2}[:-]){7}[0-9a-fA-F]{2}", "must be a valid MAC-64 address"),
    "mime": (r"[a-zA-Z0-9][a-zA-Z0-9!#$&\-^_]*/[a-zA-Z0-9][a-zA-Z0-9!#$&\-^_.+]*", "must be a valid MIME type"),
    "nanoid": ("[a-zA-Z0-9_-]{21}", "must be a valid NanoID"),
    "numeric": ("[0-9]+", "must contain only numbers"),
    "octal": ("[0-7]+", "must be a valid octal number"),
    "phone": (r"\+[1-9]\d{1,14}", "must be a valid phone number"),
    "semver": (r"\d+\.\d+\.\d+(-[a-zA-Z0-9.]+)?(\+[a-zA-Z0-9.]+)?", "must be a valid semantic version"),
    "slug": ("[a-z0-9]+(-[a-z0-9]+)*", "must be a valid slug"),
    "ulid": ("[0-9A-HJKMNP-TV-Z]{26}", "must be a valid ULID"),
    "url": (rf"[a-zA-Z][a-zA-Z0-9+.-]*://[^{SPACE}]+", "must be a valid URL"),
    "url_http": (f"https?://[^{SPACE}]+", "must be a valid HTTP URL"),
    "url_https": (f"https://[^{SPACE}]+", "must be a valid HTTPS URL"),
    "uuid": ("(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "must be a valid UUID"),
    **{f"uuid_v{n}": (_UUID % (n, "[89ab]"), f"must be a valid UUID v{n}") for n in range(1, 9)},
}


def anchored(pattern: str) -> str:
    flags, pattern = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    return rf"{flags}^(?:{pattern})\z"


def pattern_check(name: str, error: str | None = None) -> Check:
    pattern, message = PATTERNS[name]
    return on_strings(name, message, lambda v: v.rlike(anchored(pattern)), error)


def hostname(error: str | None = None) -> Check:
    pattern = anchored(rf"{_LABEL}(?:\.{_LABEL})*")
    return on_strings("hostname", "must be a valid hostname", lambda v: (utf16_length(v) <= 253) & v.rlike(pattern), error)


def iso_duration(error: str | None = None) -> Check:
    """At least one component; a T without one behind it is taken after date components."""
    pattern = anchored(r"P(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?")
    return on_strings("iso_duration", "must be a valid ISO duration", lambda v: v.rlike(pattern) & ~v.isin("P", "PT"), error)


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: F.try_to_number(x, F.lit("999")) <= 255)


_FOUR = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"


def _v4(value: Column) -> Column:
    return F.when(value.rlike(anchored(_FOUR)), _octets(value)).otherwise(False)


def _prefix(value: Column, most: int) -> Column:
    return F.try_to_number(F.substring_index(value, "/", -1), F.lit("999")) <= most


def _v4_cidr(value: Column) -> Column:
    return F.when(value.rlike(anchored(_FOUR + r"/\d{1,2}")), _octets(F.substring_index(value, "/", 1)) & _prefix(value, 32)).otherwise(False)


def _v6(value: Column) -> Column:
    return value.rlike(anchored(PATTERNS["ip_v6"][0]))


def _v6_cidr(value: Column) -> Column:
    return F.when(value.rlike(r"^[^/]*/\d{1,3}\z"), _v6(F.substring_index(value, "/", 1)) & _prefix(value, 128)).otherwise(False)


def ip(error: str | None = None) -> Check:
    return on_strings("ip", "must be a valid IP address", lambda v: _v4(v) | _v6(v), error)


def ip_v4(error: str | None = None) -> Check:
    return on_strings("ip_v4", "must be a valid IPv4 address", _v4, error)


def ip_v4_cidr(error: str | None = None) -> Check:
    return on_strings("ip_v4_cidr", "must be a valid IPv4 CIDR", _v4_cidr, error)


def ip_v6(error: str | None = None) -> Check:
    return pattern_check("ip_v6", error)


def ip_v6_cidr(error: str | None = None) -> Check:
    return on_strings("ip_v6_cidr", "must be a valid IPv6 CIDR", _v6_cidr, error)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, f"[{SPACE}-]", "")


def cc(error: str | None = None) -> Check:
    def test(v: Column) -> Column:
        digits = _stripped(v)
        return F.when(digits.rlike(r"^[0-9]{12,19}\z"), F.call_function("luhn_check", digits)).otherwise(False)

    return on_strings("cc", "must be a valid credit card number", test, error)


def imei(error: str | None = None) -> Check:
    return on_strings("imei", "must be a valid IMEI number", lambda v: F.when(v.rlike(r"^[0-9]{15}\z"), F.call_function("luhn_check", v)).otherwise(False), error)


def _weighted(number: Column, n: int, weight) -> Column:
    """The sum of the n digits of a whole number, leading zeros with them, each times weight(place)."""
    digit = lambda i: F.call_function("div", number, F.lit(10 ** (n - 1 - i))) % 10
    return functools.reduce(lambda a, b: a + b, (digit(i) * weight(i) for i in range(n)))


def isbn(error: str | None = None) -> Check:
    def ten(digits: Column, number: Column) -> Column:
        last = F.when(F.substring(digits, 10, 1) == "X", F.lit(10)).otherwise(F.substring(digits, 10, 1).try_cast("int"))
        return (_weighted(number, 9, lambda i: 10 - i) + last) % 11 == 0

    def sums(x: Column) -> Column:
        digits, number = x.getField("digits"), x.getField("number")
        right = F.when(digits.rlike(r"^[0-9]{9}[0-9X]\z"), ten(digits, number))
        return F.coalesce(right.when(digits.rlike(r"^[0-9]{13}\z"), _weighted(number, 13, lambda i: 3 if i % 2 else 1) % 10 == 0), F.lit(False))

    def test(v: Column) -> Column:  # within a lambda the stripped text and its number are variables: each is computed once
        number = lambda d: F.when(F.length(d) == 10, F.substring(d, 1, 9)).otherwise(d).try_cast("bigint")
        both = F.transform(F.array(_stripped(v)), lambda d: F.struct(d.alias("digits"), number(d).alias("number")))
        return F.get(F.transform(both, sums), F.lit(0))

    return on_strings("isbn", "must be a valid ISBN", test, error)


@functools.lru_cache(maxsize=1)
def emoji_classes() -> tuple[str, str]:
    """Character classes of Emoji_Presentation and Emoji as code point ranges, for engines without these properties."""
    import regex

    def ranges(name: str) -> str:
        shown, out = regex.compile(rf"\p{{{name}}}"), []
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and shown.match(chr(c)):
                if out and out[-1][1] == c - 1:
                    out[-1][1] = c
                else:
                    out.append([c, c])
        return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in out) + "]"

    return ranges("Emoji_Presentation"), ranges("Emoji")


def emoji_pattern() -> str:
    presentation, any_ = emoji_classes()
    one = rf"(?:{presentation}|{any_}\x{{FE0F}})"
    return rf"^{one}(?:\x{{200D}}{one})*\z"


def emoji(error: str | None = None) -> Check:
    return on_strings("emoji", "must be an emoji", lambda v: v.rlike(emoji_pattern()), error)


def _strict_json(text: str) -> bool:
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, parse_constant=refuse, parse_int=str, parse_float=str)
        return True
    except (ValueError, RecursionError):
        return False


def json_string(error: str | None = None) -> Check:
    """Parseable JSON text. The JVM's parsers are laxer or stricter, so this runs Python in Arrow batches."""

    @F.pandas_udf("boolean")
    def check(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else _strict_json(x)).astype("boolean")

    return on_strings("json_string", "must be a valid JSON string", check, error)
