"""The Arrow UDFs: rules that need the standard library."""

from __future__ import annotations

import html
import ipaddress
import json
from difflib import SequenceMatcher
from urllib.parse import urljoin, urlparse

import pandas as pd
from pyspark.sql import functions as F, types as T


@F.pandas_udf(T.DoubleType())
def gestalt(left: pd.Series, right: pd.Series) -> pd.Series:
    """Gestalt pattern ratio 2M / T, 0 if either is empty; the order of the two matters."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left, right, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: html.unescape(x) if x else x)


@F.pandas_udf(T.StringType())
def absolute_url(link: pd.Series, channel: pd.Series, base: pd.Series) -> pd.Series:
    """A feed entry's link against the channel's link, else the source's base."""

    def one(url, *bases):
        if not url or urlparse(url).netloc:
            return url
        root = next((b for b in bases if b), None)
        return urljoin(root, url) if root and urlparse(root).netloc else url

    return pd.Series([one(*x) for x in zip(link, channel, base, strict=True)], dtype="object")


@F.pandas_udf(T.BooleanType())
def public_host(host: pd.Series) -> pd.Series:
    """False for address literals of private, reserved or local networks, also inside mapped IPv6."""

    def one(name):
        if not name:
            return False
        try:
            address = ipaddress.ip_address(name.strip("[]"))
        except ValueError:
            return name.lower() != "localhost"
        return (getattr(address, "ipv4_mapped", None) or address).is_global

    return host.map(one).astype("boolean")


@F.pandas_udf(T.StringType())
def linked_data_date(block: pd.Series) -> pd.Series:
    """The first datePublished or dateCreated in a JSON-LD block, depth first."""

    def walk(node):
        below = node if isinstance(node, list) else []
        if isinstance(node, dict):
            for key in ("datePublished", "dateCreated"):
                if isinstance(node.get(key), str) and node[key].strip():
                    return node[key]
            below = node.values()
        return next((x for x in map(walk, below) if x), None)

    def one(text):
        try:
            return walk(json.loads(text)) if text else None
        except ValueError:
            return None

    return block.map(one).astype("object")
