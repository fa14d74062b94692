"""Column expressions; all of ``text`` stays inside Catalyst."""
