"""The library's words, by a regular expression over bytes."""

import re


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
