"""The optional control plane: a model, behind a protocol, reads an incident through bounded tools."""
