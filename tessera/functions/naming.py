"""Names of tables and columns from names of classes and fields."""

from __future__ import annotations

import re


def snake_case(name: str) -> str:
    """OrderLine -> order_line, HTTPServer -> http_server, UserID -> user_id."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def pluralize(word: str) -> str:
    if re.search(r"(s|x|z|ch|sh)$", word):
        return f"{word}es"
    if re.search(r"[^aeiou]y$", word):
        return f"{word[:-1]}ies"
    return f"{word}s"


def singularize(word: str) -> str:
    if word.endswith("ies") and len(word) > 3:
        return f"{word[:-3]}y"
    if re.search(r"(s|x|z|ch|sh)es$", word):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def table_name(class_name: str) -> str:
    return pluralize(snake_case(class_name))


def event_type_name(event: object) -> str:
    kind = event if isinstance(event, type) else type(event)
    return f"{kind.__module__}.{kind.__qualname__}"
