"""The vault as a stream: mentions and placeholders in, placeholders and values out, state by conversation."""

from veil.streaming.vault import mint_stream, vault_stream

__all__ = ["mint_stream", "vault_stream"]
