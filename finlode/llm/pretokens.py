"""The byte-level BPE of ``finlode.functions.pretokens``, under the name that the operators know."""

from ..functions.pretokens import Encoder, cuts, encoder, vocabulary

__all__ = ["Encoder", "cuts", "encoder", "vocabulary"]
