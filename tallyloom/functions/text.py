"""Search names, terms and folded text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a registered name that identify nobody.
LEGAL_WORDS = (
    "ab", "aktiebolag", "publ", "hb", "kb", "handelsbolag", "kommanditbolag", "ekonomisk", "forening", "ek", "for", "brf",
    "bostadsrattsforening", "stiftelse", "ideell", "i", "och", "and", "the", "sweden", "sverige", "group", "holding",
    "nordic", "scandinavia", "ltd", "inc", "as", "oy",
)
#: Letters with marks and what they are without; covers Latin-1 and Latin Extended-A letters that decompose.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"
#: Printed words for "nothing here".
NOTHING = r"(?i)^(n/?a|unknown|okänd|null|-|--)$"


def search_name(text: Column) -> Column:
    """Lower case, anything but letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def tokenize(query: Column) -> Column:
    """Terms of a search: quoted phrases and words, each as a search name; empty ones dropped."""
    found = F.regexp_extract_all(query, F.lit(r'"([^"]+)"|(\S+)'), F.lit(0))
    return F.filter(F.transform(found, search_name), lambda t: t != "")


def terms(query: str) -> list[str]:
    """The same for a search that the caller typed."""
    found = [a or b for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
    return [t for t in (re.sub(r"[\W_]+", " ", f.lower()).strip() for f in found) if t]


def fold(text: Column) -> Column:
    """Lower case without marks; anything but a-z and 0-9 one blank."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), MARKED, PLAIN), "[^a-z0-9]+", " "))


def significant_tokens(name: Column) -> Column:
    """Folded words without legal forms and single letters; all words if none is left."""
    every = F.filter(F.split(fold(name), " "), lambda w: w != "")
    some = F.filter(every, lambda w: ~w.isin(*LEGAL_WORDS) & (F.length(w) > 1))
    return F.when(F.size(some) > 0, some).otherwise(every)


def all_in(haystack: Column, wanted: list[str]) -> Column:
    """Whether haystack contains every one of wanted."""
    out = F.lit(True)
    for t in wanted:
        out = out & F.contains(haystack, F.lit(t))
    return out


def any_in(haystack: Column, wanted: list[str]) -> Column:
    out = F.lit(False)
    for t in wanted:
        out = out | F.contains(haystack, F.lit(t))
    return out


def nothing_to_null(text: Column) -> Column:
    t = F.trim(text)
    return F.when((t != "") & ~t.rlike(NOTHING), t)


#: Keys, without marks, whose values are never shown; further ones under secrets, and in a pairing request.
SENSITIVE = (
    "authorization", "cookie", "setcookie", "password", "apikey", "aiapikey", "apiverketapikey", "token", "accesstoken", "refreshtoken",
    "devicetoken", "qrimage", "pairingpayload",
)
HIDDEN = "[redacted]"


def _hidden(value: object, key: str, secret: bool, pairing: bool) -> object:
    plain = re.sub("[^a-z0-9]", "", key.lower())
    if plain in SENSITIVE or (plain == "value" and secret) or (plain == "code" and pairing):
        return HIDDEN
    if isinstance(value, dict):
        return {k: _hidden(v, k, secret or plain == "secrets", pairing) for k, v in value.items()}
    if isinstance(value, list):
        return [_hidden(v, "", secret or plain == "secrets", pairing) for v in value]
    return value


def redact_json(body: Column, path: Column) -> Column:
    """JSON with the values of sensitive keys blanked at any depth; text that is no JSON stays as it is.

    path is that of the request: under /secrets, and within a key of that name, value is sensitive too, and code is in
    /auth/pair. Built-in expressions cannot go down to any depth, so this is an Arrow function.
    """

    def run(bodies: pd.Series, paths: pd.Series) -> pd.Series:
        out = []
        for b, p in zip(bodies, paths, strict=True):
            try:
                out.append(b if b is None else json.dumps(_hidden(json.loads(b), "", (p or "").startswith("/secrets"), (p or "").startswith("/auth/pair")), ensure_ascii=False, separators=(",", ":")))
            except ValueError:
                out.append(b)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "string")(body, path)


def redact_url(url: Column) -> Column:
    """Path and query of an address with the values of sensitive parameters and of code blanked."""
    local = F.regexp_replace(F.regexp_replace(url, "^[a-z][a-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    path, query = F.regexp_extract(local, r"^[^?]*", 0), F.regexp_extract(local, r"\?(.*)$", 1)
    plain = lambda p: F.regexp_replace(F.lower(F.split(p, "=")[0]), "[^a-z0-9]", "")
    shown = F.transform(F.split(query, "&"), lambda p: F.when(plain(p).isin(*SENSITIVE, "code"), F.concat(F.split(p, "=")[0], F.lit("=%5Bredacted%5D"))).otherwise(p))
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), F.array_join(shown, "&"))))


def redact_headers(headers: Column) -> Column:
    """A map of headers with the values of sensitive names blanked."""
    return F.transform_values(headers, lambda k, v: F.when(F.regexp_replace(F.lower(k), "[^a-z0-9]", "").isin(*SENSITIVE), HIDDEN).otherwise(v))


def redact(text: Column) -> Column:
    """Text with the values of sensitive keys, bearer tokens and query secrets blanked."""
    t = F.regexp_replace(text, r'(?i)("?(?:password|secret|token|authorization|api_?key)"?\s*[:=]\s*)("[^"]*"|[^\s,&}]+)', '$1"[redacted]"')
    return F.regexp_replace(t, r"(?i)bearer\s+[a-z0-9._~+/=-]+", "Bearer [redacted]")
