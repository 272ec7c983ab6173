"""Settings of the masking engine."""

import os
from dataclasses import dataclass, field, fields

#: Whole values, and beginnings before a space, that are no person. Fixed values.
DENY = (
    "task", "tasks", "json", "json output", "json array", "json array of strings", "raw", "output", "input", "true",
    "false", "null", "none", "undefined", "default", "auto", "custom", "emoji", "emojis", "emoji summarizing",
    "emojis summarizing", "emoji summarizing the conversation", "emojis that enhance understanding", "summarize",
    "summarization", "summary", "assistant", "user", "system", "prompt", "response", "completion", "get", "post",
    "put", "delete", "patch", "request", "endpoint", "header", "body", "payload", "please", "thank you", "error",
    "warning", "info", "debug", "success", "failed", "pending", "moj oib", "moja oib", "moj jmbg", "moja jmbg",
    "moj iban", "moja iban", "moj email", "moja email", "moja mail", "moj telefon", "moj mobitel", "moja adresa",
    "moj broj", "email", "mail", "adresa", "broj", "oib", "jmbg", "iban", "ime", "prezime",
)
#: Whole values that are no person. Fixed values.
EXACT_DENY = (
    "claude", "opus", "sonnet", "haiku", "gpt", "chatgpt", "gemini", "bard", "copilot", "llama", "mistral", "mixtral",
    "grok", "deepseek", "qwen",
)
#: Last words that are not part of a name. Fixed values.
TRAILING = (
    "has", "had", "have", "is", "was", "are", "were", "be", "been", "being", "does", "did", "do", "says", "said",
    "say", "goes", "went", "go", "comes", "came", "come", "je", "su", "ima", "imaju", "bio", "bila", "bile", "bili",
    "kaže", "rekao", "rekla", "rekli", "ide", "došao", "došla",
)


@dataclass(frozen=True)
class EngineConfig:
    """Literals of a plan. ``from_env`` reads VEIL_ variables."""

    enabled: bool = True
    detection_enabled: bool = True
    languages: tuple[str, ...] = ("hr", "en")
    degradation_mode: str = "block"
    vault_enabled: bool = True
    thread_ttl_seconds: int = 86_400
    ephemeral_ttl_seconds: int = 600
    encryption_enabled: bool = False
    encryption_strict: bool = False
    key_id: int = 1
    deny: tuple[str, ...] = DENY
    exact_deny: tuple[str, ...] = EXACT_DENY
    trailing: tuple[str, ...] = TRAILING
    coreference: bool = True
    oib_phone_window: int = 30
    detector_threshold: float = 0.5
    history_scope: bool = True
    history_messages: int = 20
    skip_tasks: tuple[str, ...] = field(default=("title_generation", "tags_generation", "follow_up_generation"))

    def validate(self) -> "EngineConfig":
        if not self.languages or not set(self.languages) <= {"hr", "en"}:
            raise ValueError("languages: some of hr and en")
        if not 0 <= self.oib_phone_window <= 200:
            raise ValueError("oib_phone_window: 0 to 200")
        if not 0 <= self.history_messages <= 100:
            raise ValueError("history_messages: 0 to 100")
        if not 0 <= self.detector_threshold <= 1:
            raise ValueError("detector_threshold: 0 to 1")
        if min(self.thread_ttl_seconds, self.ephemeral_ttl_seconds) <= 0:
            raise ValueError("times to live are positive")
        return self

    @property
    def passes_through(self) -> bool:
        """Any other mode than passthrough blocks."""
        return self.degradation_mode == "passthrough"

    @classmethod
    def from_env(cls, env: dict | None = None) -> "EngineConfig":
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = env.get(f"VEIL_{f.name.upper()}")
            if raw is None:
                continue
            now = f.default if f.default is not f.default_factory else ()
            if isinstance(now, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on")
            elif isinstance(now, (int, float)):
                found[f.name] = type(now)(raw)
            elif isinstance(now, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                found[f.name] = raw
        return cls(**found).validate()
