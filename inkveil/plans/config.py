"""Configuration: a JSON text with ${NAME} for environment variables, read on the driver."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence

from inkveil.functions.lexicon import Lexicon


def interpolated(text: str, env: Mapping[str, str] | None = None) -> str:
    """${NAME} becomes the variable's value, quoted as JSON text; names that are not set stay as they are."""
    env = os.environ if env is None else env
    return re.sub(r"\$\{(\w+)\}", lambda m: json.dumps(env[m[1]])[1:-1] if m[1] in env else m[0], text)


def read(paths: Sequence[str], env: Mapping[str, str] | None = None) -> dict:
    """The first of the files that is there; without any an empty configuration."""
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                return json.loads(interpolated(f.read(), env))
    return {}


def lexicon(config: Mapping) -> Lexicon:
    """The lexicon that a configuration describes; what it leaves out keeps its default."""
    d = Lexicon()
    own = lambda key, default: tuple(config[key]) if isinstance(config.get(key), list) else default
    joined = lambda key, default: "".join(config[key]) if config.get(key) else default
    return Lexicon(
        placeholders=d.placeholders | dict(config.get("replacement") or {}), bank_names=own("bank_names", d.bank_names), surnames=joined("surname_pool", d.surnames),
        name_chars=joined("name_pool", d.name_chars), org_suffixes=own("org_suffixes", d.org_suffixes),
        bare_branches=own("bank_branch_suffixes", d.bare_branches) or d.bare_branches, given_chars=joined("given_pool", d.given_chars),
    )
