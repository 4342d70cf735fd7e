"""Secrets out of text and mount options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BEFORE, _AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"  # word edges, for ASCII letters alone: a secret may follow any other letter
_NAME = "(?=(?iu:[A-Z0-9_]++)=)"  # nothing but a name before an equals sign is looked through for a secret's
# What counts as a secret and what is put in its place, in the order in which it is replaced.
SECRETS = (
    (_BEFORE + _NAME + r"((?iu:[A-Z0-9_]*(?:PASSWORD|PASSWD|SECRET|TOKEN|APIKEY|API_KEY|AUTH|CREDENTIAL|PRIVATE_KEY)[A-Z0-9_]*))=([^ \t\n\f\r;|&]+)", "$1=<redacted>"),
    (_BEFORE + r"AKIA[0-9A-Z]{16}" + _AFTER, "<redacted>"),
    (_BEFORE + r"gh[opsur]_[A-Za-z0-9]{36,}" + _AFTER, "<redacted>"),
    (r"((?iu:bearer))[ \t\n\f\r]+((?iu:[A-Za-z0-9._\-]+))", "$1 <redacted>"),
)
# Mount options that hold credentials.
OPTION_KEYS = ("password", "credentials", "cred")


def redacted(text: Column) -> Column:
    for pattern, put in SECRETS:
        text = F.regexp_replace(text, pattern, put)
    return text


def mount_options(options: Column) -> Column:
    """Options sorted and rejoined, without those that name credentials."""
    plain = F.filter(F.split(options, ","), lambda x: ~F.lower(F.substring_index(x, "=", 1)).isin(*OPTION_KEYS))
    return F.array_join(F.array_sort(plain), ",")
