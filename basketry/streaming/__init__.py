"""The batch chain run as files arrive."""
