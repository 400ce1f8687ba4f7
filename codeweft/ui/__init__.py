"""The page that the server shows at its root."""
