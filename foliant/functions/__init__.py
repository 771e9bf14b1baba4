"""See the package's docstring for what lives here."""
