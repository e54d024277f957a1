"""Settings of a memory: which model plays which role, its keys, and the persona. Nothing is written to disk."""

from __future__ import annotations

import os
from collections.abc import MutableMapping
from dataclasses import dataclass, field

#: The kinds of model that a role can have.
PROVIDERS = ("local", "gemini", "openAI", "anthropic")
#: The persona before it is set.
DEFAULT_NAME, DEFAULT_PERSONALITY = "Assistant", "Helpful, concise, and direct."


def known(kind: str | None) -> str:
    """The kind, or local for one that is not known."""
    return kind if kind in PROVIDERS else "local"


@dataclass
class MemorySettings:
    """Models of the two roles, chosen apart, and a key for each kind of model.

    Keys live in the process's environment, or in whatever mapping is given.
    """

    extraction: str = "local"
    chat: str = "local"
    secrets: MutableMapping[str, str] = field(default_factory=lambda: os.environ, repr=False)
    prefix: str = "MNEMOGRAPH_KEY_"

    def __post_init__(self) -> None:
        self.extraction, self.chat = known(self.extraction), known(self.chat)

    def select(self, role: str, kind: str) -> bool:
        """Give a role another model; False if it has that already."""
        if role not in ("extraction", "chat") or kind not in PROVIDERS:
            raise ValueError(f"no such role or kind: {role}, {kind}")
        changed = getattr(self, role) != kind
        setattr(self, role, kind)
        return changed

    def key(self, kind: str) -> str | None:
        return self.secrets.get(self.prefix + kind.upper())

    def set_key(self, kind: str, key: str) -> None:
        self.secrets[self.prefix + kind.upper()] = key

    def clear_key(self, kind: str) -> None:
        self.secrets.pop(self.prefix + kind.upper(), None)


@dataclass
class Persona:
    """Who the assistant is; ``user_name`` is that of the person it talks to, empty until it is known."""

    name: str = DEFAULT_NAME
    personality: str = DEFAULT_PERSONALITY
    user_name: str = ""

    def update(self, name: str, personality: str) -> bool:
        """False if nothing changes."""
        changed = (name, personality) != (self.name, self.personality)
        self.name, self.personality = name, personality
        return changed

    def update_user_name(self, value: str) -> bool:
        """White space and newlines around a name do not count; False if nothing changes."""
        trimmed = value.strip()
        changed = trimmed != self.user_name
        self.user_name = trimmed
        return changed
