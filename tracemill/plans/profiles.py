"""What is known of a kind of log before it is read."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    domain: str = "unknown"
    #: A known fingerprint decides from this confidence on; a model is asked below that one.
    cache_confidence: float = 0.8
    ask_below: float = 0.7
    expected_types: dict[str, str] = field(default_factory=dict)
    hints: dict[str, str] = field(default_factory=dict)

    def missing(self, columns: list[str]) -> list[str]:
        """Expected columns that a table lacks."""
        return [c for c in self.expected_types if c not in columns]


_profiles = {"default": Profile("default")}


def register_profile(profile: Profile) -> None:
    _profiles[profile.name] = profile


def get_profile(name: str | None) -> Profile:
    """The profile of this name, the default for an unknown one."""
    return _profiles.get((name or "default").strip() or "default", _profiles["default"])
