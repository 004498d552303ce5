"""mirrorsift subpackage."""
