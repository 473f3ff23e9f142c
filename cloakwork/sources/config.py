"""Configurations from YAML, with values from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml

from cloakwork.plans.catalog import MIN_CONFIDENCE, PROFILES, TYPES, Allowlists, Combination, Config, ConfigError, Context, Pattern, Profile, Strategy, System, TypeDef, with_types

_VARIABLE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def interpolate(text: str, environment: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} replaced; an empty value takes the default."""
    env = os.environ if environment is None else environment
    return _VARIABLE.sub(lambda m: env.get(m[1]) or m[2] or "", text)


def _only(section: dict, allowed: str, where: str) -> dict:
    section = dict(section or {})
    if unknown := set(section) - set(allowed.split()):
        raise ConfigError(f"{where}: unknown {', '.join(sorted(unknown))}")
    return section


def type_of(raw: dict) -> TypeDef:
    raw = _only(raw, "id description kind patterns validator context confidence priority enabled digit_boundary weak soft_validator companions group", "pii_types")
    if "id" not in raw:
        raise ConfigError("pii_types: a type without id")
    context = _only(raw.get("context"), "before after window required boost suppress", f"context of {raw['id']}")
    patterns = []
    for p in raw.get("patterns", ()):
        p = {"regex": p} if isinstance(p, str) else _only(p, "regex requires_context confidence", f"pattern of {raw['id']}")
        patterns.append(Pattern(**p))
        try:
            re.compile(patterns[-1].source)
        except re.error as e:
            raise ConfigError(f"pattern of {raw['id']}: {e}") from None
    validator, length = raw.get("validator", "none"), (0, 0)
    if isinstance(validator, dict):
        limits = validator.get("digits_len", {})
        validator, length = "digits_len", (limits.get("min", 0), limits.get("max", 0))
    if validator not in ("none", "luhn", "inn", "snils", "date", "phone", "digits_len"):
        raise ConfigError(f"{raw['id']}: unknown validator {validator!r}")
    plain = {k: raw[k] for k in ("id", "description", "confidence", "priority", "enabled", "digit_boundary", "weak", "soft_validator", "group") if k in raw}
    lists = {k: tuple(v) if isinstance(v, list) else v for k, v in context.items()}
    return TypeDef(**plain, patterns=tuple(patterns), validator=validator, length=length, context=Context(**lists), companions=tuple(raw.get("companions", ())), builtin=raw.get("kind", "pattern") == "builtin")


def system_of(raw: dict) -> System:
    raw = _only(raw, "id description enabled auth pii_types exclude_types demask profile overrides combination_rules weak_entities address_mode min_confidence", "systems")
    auth = _only(raw.pop("auth", {}), "api_keys anonymous", f"auth of {raw.get('id')}")
    raw.pop("description", None)
    rules = tuple(Combination(r["mask"], tuple(r["only_if_present"]), r.get("window", 0)) for r in raw.pop("combination_rules", ()))
    for k in ("pii_types", "exclude_types"):
        if isinstance(raw.get(k), list):
            raw[k] = tuple(raw[k])
    return System(**raw, api_keys=tuple(auth.get("api_keys", ())), anonymous=auth.get("anonymous", False), combination_rules=rules)


def config_of(raw: dict[str, Any] | None) -> Config:
    """A configuration from its sections; sections about serving are accepted and not used."""
    raw = _only(raw, "server store llm admin logging ui masking detection allowlists pii_types profiles systems dictionaries", "configuration")
    detection = _only(raw.get("detection"), "context_window min_confidence", "detection")
    allow = _only(raw.get("allowlists"), "public_persons public_addresses public_phones public_phone_prefixes corporate_email_domains public_person_cues public_address_cues", "allowlists")
    allow = {k: tuple(v) for k, v in allow.items() if not k.endswith("_cues")}
    profiles = dict(PROFILES)
    for name, p in (raw.get("profiles") or {}).items():
        p = _only(p, "description default types", f"profile {name}")
        profiles[name] = Profile(Strategy.of(p.get("default", "full")), {k: Strategy.of(v) for k, v in (p.get("types") or {}).items()}, p.get("description", ""))
    lists = _only(raw.get("dictionaries"), "dir extra", "dictionaries")
    systems = tuple(map(system_of, raw["systems"])) if raw.get("systems") else (System("default", anonymous=True),)
    return Config(
        with_types(TYPES, [type_of(t) for t in raw.get("pii_types") or ()]), profiles, systems, Allowlists(**allow), (raw.get("masking") or {}).get("secret") or "",
        detection.get("context_window", 48), detection.get("min_confidence", MIN_CONFIDENCE), lists.get("dir"), tuple((x["class"], x["path"]) for x in lists.get("extra", ())),
    )


def read_config(path: str | Path, environment: Mapping[str, str] | None = None) -> Config:
    return config_of(yaml.safe_load(interpolate(Path(path).read_text("utf-8"), environment)))
