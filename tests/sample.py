"""A small project in eight languages, for queries whose meaning is on code."""

SOURCES = {
    "src/main.ts": "import { signIn, signOut } from './session.js'\nimport type { Account } from './kinds/index.js'\nimport * as path from 'path'\n\nexport async function onEnter(a: Account) {\n  console.log(a)\n  return signIn(a)\n}\n\nexport function onLeave(a: Account) {\n  return signOut(a)\n}\n",
    "src/session.ts": "import { digest } from './lib/text.js'\n\nexport const LIMIT = 3\nconst NEVER = 1\n\n/** Begins a session. */\nexport async function signIn(a: object) {\n  try {\n    return prepare(digest(a))\n  } catch (e) {\n    console.error(e)\n  }\n}\n\nfunction prepare(x: string) {\n  return x.trim()\n}\n\nexport function signOut(a: object) {\n  return fetch('/out')\n}\n",
    "src/lib/text.ts": "export function digest(x: object): string {\n  return String(x)\n}\n\nexport class Words {\n  count(x: string) {\n    return digest({})\n  }\n}\n",
    "src/kinds/index.ts": "export { Account, Role } from './account.js'\n",
    "src/kinds/account.ts": "export interface Account {\n  id: string\n}\n\nexport enum Role {\n  A,\n}\n\nexport type Key = string\n",
    "src/view.tsx": "import { onEnter } from './main'\n\nexport const View = () => {\n  return <b onClick={() => onEnter({})}>x</b>\n}\n",
    "lib/tool.py": "import os\nfrom .util import load as get\n\n\nclass Tool:\n    \"\"\"A tool.\"\"\"\n\n    async def run(self, path: str) -> int:\n        return get(os.getenv(path))\n\n\ndef _hidden():\n    pass\n",
    "lib/util.py": "def load(x):\n    return open(x)\n",
    "app/auth/auth.go": "package auth\n\nimport \"fmt\"\n\n// Store holds names.\ntype Store struct{ n int }\n\nfunc (s *Store) Open(name string) error {\n\tfmt.Println(name)\n\treturn check(name)\n}\n\nfunc check(name string) error { return nil }\n",
    "app/main.go": "package main\n\nimport \"example.com/demo/app/auth\"\n\nfunc main() { auth.New() }\n",
    "src/lib.rs": "use crate::store::Shelf;\n\npub struct Desk {\n    n: u32,\n}\n\nimpl Desk {\n    pub fn tidy(&self) -> u32 {\n        helper(self.n)\n    }\n}\n\nfn helper(n: u32) -> u32 {\n    n\n}\n",
    "src/store.rs": "pub trait Shelf {\n    fn put(&self);\n}\n",
    "src/a/Box.java": "package a;\n\nimport a.Lid;\nimport java.util.List;\n\npublic class Box {\n    /** Opens it. */\n    public void open(Lid lid) {\n        lid.lift();\n    }\n}\n",
    "src/a/Lid.java": "package a;\n\npublic interface Lid {\n    void lift();\n}\n",
    "src/Door.cs": "using System;\n\nnamespace House\n{\n    public class Door\n    {\n        public int Width { get; set; }\n\n        public void Shut()\n        {\n            Console.WriteLine(Width);\n        }\n    }\n}\n",
    "src/old.js": "const { digest } = require('./lib/text')\n\nfunction plain(x) {\n  return digest(x)\n}\n\nmodule.exports = { plain }\n",
}
MODULE = "example.com/demo"
