"""Part of the dossier package."""
