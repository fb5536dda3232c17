"""Finds hidden and disguised advertising in stored web content, as DataFrame plans."""
