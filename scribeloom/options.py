"""Options passed to the operators. Plain frozen dataclasses, never tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from scribeloom.functions import fixed


@dataclass(frozen=True)
class PrefixLists:
    """Name prefixes per category; an empty list stands for the defaults."""

    create: tuple[str, ...] = fixed.CREATE_PREFIXES
    read: tuple[str, ...] = fixed.READ_PREFIXES
    update: tuple[str, ...] = fixed.UPDATE_PREFIXES
    delete: tuple[str, ...] = fixed.DELETE_PREFIXES

    def by_category(self) -> list[tuple[str, tuple[str, ...]]]:
        """Categories in match order with the prefixes in force."""
        given = (self.create, self.read, self.update, self.delete)
        usual = (fixed.CREATE_PREFIXES, fixed.READ_PREFIXES, fixed.UPDATE_PREFIXES, fixed.DELETE_PREFIXES)
        return [
            (category, tuple(p.lower() for p in (mine or default)))
            for category, mine, default in zip(fixed.CATEGORIES, given, usual)
        ]


@dataclass(frozen=True)
class ContextOptions:
    type_depth: int = 2
    called_depth: int = 1
    collect_called: bool = True
    max_chars: int = 20000
    type_suffixes: tuple[str, ...] = fixed.TYPE_SUFFIXES
    package_keywords: tuple[str, ...] = fixed.PACKAGE_KEYWORDS
    annotation_whitelist: tuple[str, ...] = fixed.ANNOTATION_WHITELIST


@dataclass(frozen=True)
class RetryOptions:
    enabled: bool = True
    max_attempts: int = 3
    backoff_ms: int = 1500


@dataclass(frozen=True)
class RequestOptions:
    provider: str = "OPENAI"
    endpoint: str = "http://127.0.0.1:8000/v1/chat/completions"
    model: str = "Qwen-32B"
    max_tokens: int = 4096
    temperature: float = 0.7
    top_p: float = 1.0
    # Preset values offered for the second hosted provider.
    deepseek_endpoint: str = "https://api.deepseek.com/v1/chat/completions"
    deepseek_model: str = "deepseek-chat"


@dataclass(frozen=True)
class PromptOptions:
    custom_enabled: bool = False
    custom_template: str = ""


@dataclass(frozen=True)
class OutputOptions:
    write_markdown: bool = True
    write_doc: bool = True
    group_by_module: bool = False


@dataclass(frozen=True)
class Options:
    annotation: str = "@RpcService"
    per_class: bool = False
    module: str = "ALL"
    categories: tuple[str, ...] = (*fixed.CATEGORIES, fixed.OTHER)
    prefixes: PrefixLists = field(default_factory=PrefixLists)
    context: ContextOptions = field(default_factory=ContextOptions)
    retry: RetryOptions = field(default_factory=RetryOptions)
    request: RequestOptions = field(default_factory=RequestOptions)
    prompt: PromptOptions = field(default_factory=PromptOptions)
    output: OutputOptions = field(default_factory=OutputOptions)
    max_concurrent: int = 2
    queue_size: int = 32
    requests_per_second: float = 1.5
    history_limit: int = 200
    page_size: int = 20
