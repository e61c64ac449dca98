"""Where a language model may be asked, and what it may cost. Without one, nothing here runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

# Characters for a token, US dollars for a million tokens.
CHARS_A_TOKEN, INPUT_PRICE, OUTPUT_PRICE = 4, 0.25, 1.50


@dataclass
class Budget:
    """Counts what calls cost by the length of their texts, and stops at a limit."""

    limit_usd: float | None = None
    input_tokens: int = 0
    output_tokens: int = 0

    @staticmethod
    def tokens(text: str) -> int:
        return len(text) // CHARS_A_TOKEN

    @property
    def cost_usd(self) -> float:
        return (self.input_tokens * INPUT_PRICE + self.output_tokens * OUTPUT_PRICE) / 1e6

    def allows(self, prompt: str) -> bool:
        return self.limit_usd is None or self.cost_usd + self.tokens(prompt) * INPUT_PRICE / 1e6 <= self.limit_usd

    def spend(self, prompt: str, answer: str) -> None:
        self.input_tokens += self.tokens(prompt)
        self.output_tokens += self.tokens(answer)


def ask_json(model: Callable[[str], str], prompt: str, budget: Budget, retries: int = 2) -> dict | None:
    """The model's answer as an object; a wrong one is sent back with its error. None if none is right or affordable."""
    text = prompt
    for _ in range(retries + 1):
        if not budget.allows(text):
            return None
        answer = model(text)
        budget.spend(text, answer)
        try:
            found = json.loads(answer)
            if isinstance(found, dict):
                return found
            error = "not an object"
        except ValueError as e:
            error = str(e)
        text = f"{prompt}\n\nThe last answer was wrong: {error}. Answer with one JSON object."
    return None
