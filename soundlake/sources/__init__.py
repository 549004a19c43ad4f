"""Readers and writers: folders of recordings, playlists, want lists and exports."""
