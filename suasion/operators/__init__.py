"""Relational operators over candidates, ledgers, offers, views and labels."""
